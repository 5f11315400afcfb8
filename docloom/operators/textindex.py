"""A stored inverted index with positions: phrase, nearness and BM25 searches that read only the terms they ask for.

``build`` writes, once, below a folder:

* ``postings``: one row per term and block of chunks (a block is at most ``BLOCK`` chunks that were read together), with
  the chunks that hold the term, the places of the term in each, each chunk's length, and the block's largest frequency and smallest length; partitioned by
  a hash of the term and sorted by term, so a search opens the folders of its terms and skips the row groups of others;
* ``terms``: document frequencies; ``facts``: number of chunks, mean length, and the mark that the index is whole.

Every word is a posting, stop words too (each term is apart on disk, so a search that does not ask for them never meets
them): phrases may hold them, and each document's language says which words a search drops.
A term that stands in a third of all chunks is many rows, one a block.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators.search import STOP, small, top
from docloom.sources.shared import Scratch, Store

# French stop words of the text search.
FRENCH = ("au", "aux", "avec", "ce", "dans", "de", "des", "du", "elle", "en", "et", "il", "je", "la", "le", "les", "leur", "mais", "ne", "nous", "on", "ou", "par", "pas", "pour", "qui", "que", "se", "sur", "un", "une", "vous")
#: Stop words by language; other languages have none.
LANGUAGES = {"en": STOP, "fr": FRENCH}
#: BM25's saturation and length weights, chunks of a block, hash partitions of the terms and files of each.
K1, B, BLOCK, BUCKETS, SPREAD = 1.2, 0.75, 4096, 64, 4
#: Columns of the postings (besides their bucket): a row is one term in one block.
#: Chunks, their lengths and the ends of their places lie in arrays of equal length; all places follow each other in one.
POSTINGS = "term string, block bigint, df bigint, tokens bigint, most int, least int, chunks array<bigint>, lengths array<int>, ns array<int>, ends array<int>, places array<int>"
#: Blocks that a BM25 search reads first, best bound first.
SEEDS = 2
#: Without an index: bytes of text in a block of chunks, (query, word) pairs in a group of queries, groups that are still broadcast, and blocks in a file of the scan.
BYTES, PAIRS, FEW_GROUPS, ROWS = 12_000_000, 65_536, 4, 4


def words(c: Column) -> Column:
    """All lower-case words of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def kept(terms: Column, language: Column) -> Column:
    """The words that are not stop words of the language."""
    stop = F.create_map(*[x for k, v in LANGUAGES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[language]
    return F.filter(terms, lambda w: ~F.coalesce(F.array_contains(stop, w), F.lit(False)))


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass
class Index:
    """A built index; ``facts`` has chunks, mean_length, buckets, blocks."""

    spark: SparkSession
    path: str
    facts: dict

    def terms(self) -> DataFrame:
        return self.spark.read.schema("term string, df bigint").parquet(f"{self.path}/terms")

    def postings(self, asked: DataFrame) -> DataFrame:
        """Posting rows of the asked terms (column ``term``): only the folders of their hash are opened.

        The hashes are at most ``buckets`` numbers.
        """
        folders = sorted(r[0] for r in asked.select(bucket(F.col("term"), self.facts["buckets"])).distinct().collect())
        rows = self.spark.read.schema(f"{POSTINGS}, bucket int").parquet(f"{self.path}/postings").where(F.col("bucket").isin(folders))
        return rows.join(small(asked.select("term").distinct()), "term", "left_semi")


def build(chunks: DataFrame, path: str, block: int = BLOCK, buckets: int = BUCKETS) -> Index:
    """Index of chunks (chunk_id, chunk_text, language); an index that is whole at ``path`` is opened, not built again.

    Null texts hold no words and count as chunks; a chunk id must be given once; other columns are not read.
    """
    spark = chunks.sparkSession
    store = Store(spark, path)
    if store.exists("facts.json"):
        return Index(spark, path, json.loads(store.read("facts.json")))
    cut = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("language").cast("string").alias("language"), words(F.col("chunk_text")).alias("w"))
    rows = cut.mapInArrow(lambda batches: _inverted(batches, block), POSTINGS).withColumn("bucket", bucket(F.col("term"), buckets))
    # a bucket is SPREAD files, so a term of a third of all chunks is not one task's
    placed = rows.repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(SPREAD))).sortWithinPartitions("bucket", "term", "block")
    placed.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(store.at("postings"))
    whole = spark.read.schema(f"{POSTINGS}, bucket int").parquet(store.at("postings"))
    terms = whole.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("df").alias("df"))
    terms.write.mode("overwrite").parquet(store.at("terms"))
    told = whole.agg(F.coalesce(F.sum(F.when(F.col("term").isNull(), F.col("df"))), F.lit(0)).alias("chunks"), F.count_if(F.col("term").isNull()).alias("blocks"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    facts = {"chunks": told["chunks"], "blocks": told["blocks"], "buckets": buckets, "mean_length": told["tokens"] / max(told["chunks"], 1)}
    store.create("facts.json", json.dumps(facts))  # last: the mark of a whole index
    return Index(spark, path, facts)


def _inverted(batches: Iterator[pa.RecordBatch], block_size: int) -> Iterator[pa.RecordBatch]:
    """Posting rows of chunks (chunk_id, language, w), a block of chunks at a time: its words sorted by term, chunk and place at once.

    ``length`` counts a chunk's words that are no stop words of its language, ``n`` those that are no English ones; ``tokens`` adds up the first.
    A row without a term tells a block's number of chunks (as ``df``).
    """
    names = ["term", "block", "df", "tokens", "most", "least", "chunks", "lengths", "ns", "ends", "places"]
    none = [pa.array([0], pa.int32())] * 2 + [pa.array([[]], pa.list_(t)) for t in (pa.int64(), *[pa.int32()] * 4)]
    block = TaskContext.get().partitionId() << 32
    for batch in (whole.slice(k, block_size) for whole in batches for k in range(0, whole.num_rows, block_size)):
        block += 1
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([block]), pa.array([batch.num_rows]), pa.array([0]), *none], names=names)
        chunk, language, w = batch.columns
        sizes = pc.fill_null(pc.list_value_length(w), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = w.flatten().dictionary_encode()
        if not len(coded):
            continue
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        term = coded.indices.to_numpy().astype(np.int64)
        stop = {k: np.asarray(pc.is_in(coded.dictionary, pa.array(v, pa.string()))) for k, v in LANGUAGES.items()}
        english = ~stop["en"][term]
        counted = np.ones(len(row), bool)
        for k, dropped in stop.items():
            counted &= ~(dropped[term] & np.asarray(pc.fill_null(pc.equal(language, k), False))[row])
        length, n = (np.bincount(row, weights=x, minlength=len(sizes)).astype(np.int32) for x in (counted, english))
        order = np.lexsort((row, term))  # stable: places stay in order
        term, row, place, counted = term[order], row[order], place[order].astype(np.int32), counted[order]
        new_term = np.concatenate([[True], term[1:] != term[:-1]])
        entry = np.flatnonzero(new_term | np.concatenate([[True], row[1:] != row[:-1]]))
        first = np.flatnonzero(new_term[entry])
        own, tf = row[entry], np.diff(np.append(entry, len(row)))
        bounds = pa.array(np.append(first, len(entry)), pa.int32())
        ends = np.cumsum(tf)
        before = np.repeat(entry[first], np.diff(np.append(first, len(entry))))  # places of earlier terms
        lists = [pa.ListArray.from_arrays(bounds, x) for x in (chunk.take(pa.array(own)), pa.array(length[own]), pa.array(n[own]), pa.array((ends - before).astype(np.int32)))]
        yield pa.RecordBatch.from_arrays([
            coded.dictionary.take(pa.array(term[entry[first]])), pa.array(np.full(len(first), block)), pa.array(np.diff(np.append(first, len(entry)))), pa.array(np.add.reduceat(counted.astype(np.int64), entry[first])),
            pa.array(np.maximum.reduceat(tf, first).astype(np.int32)), pa.array(np.minimum.reduceat(length[own], first)), *lists,
            pa.ListArray.from_arrays(pa.array(np.append(entry[first], len(row)), pa.int32()), pa.array(place)),
        ], names=names)


def asked_terms(queries: DataFrame, language: Column | None = None) -> DataFrame:
    """(query_id, term, offset, need) of queries (query_id, query): each word that is no stop word of the language (English by default) at its place, and how many there are."""
    w = words(F.col("query"))
    each = queries.select("query_id", (F.lit("en") if language is None else language).alias("_l"), F.posexplode(w).alias("offset", "term"))
    stay = each.where(F.size(kept(F.array("term"), F.col("_l"))) == 1).drop("_l")
    return stay.join(small(stay.groupBy("query_id").agg(F.countDistinct("term").alias("need"))), "query_id")


def _blocks(index: Index, asked: DataFrame, wanted: DataFrame, lists: list[str], each: Callable[[_Block, pa.Table, int, int], dict | None], schema: str, some: bool = False) -> DataFrame:
    """What ``each`` finds for every query in every block, where all its words meet without a row for each pair of query and entry.

    ``wanted`` (block, query_id, term, more) are short rows; the postings of the asked terms, with their array columns ``lists``, are shuffled
    once by block, however many queries share a term.  A block is at most ``BLOCK`` chunks, so its postings are small.  With ``some``, postings of blocks
    that are not wanted are left out first.
    """
    kind = wanted.schema["query_id"].dataType.simpleString()
    empty = index.spark.createDataFrame([], f"query_id {kind}, {schema}").limit(0).toArrow()  # the columns of no rows, without a task
    rows = index.postings(asked).select("block", "term", "chunks", "ends", *lists)
    if some:
        rows = rows.join(small(wanted.select("block").distinct()), "block", "left_semi")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            held = _Block(left)
            at = pc.index_in(right["term"], left["term"].combine_chunks())
            right = right.append_column("_at", at).filter(pc.is_valid(at)).sort_by("query_id")
            ids = right["query_id"].combine_chunks()
            edges = np.flatnonzero(np.asarray(pc.not_equal(ids[1:], ids[:-1]), bool)) + 1
            for i, j in zip([0, *edges], [*edges, len(ids)], strict=True):
                found = each(held, right, int(i), int(j)) if j > i else None
                if found is not None and len(next(iter(found.values()))):
                    n = len(next(iter(found.values())))
                    out.append(pa.table({"query_id": ids.take(pa.array(np.full(n, i))), **found}))
        return pa.concat_tables(out) if out else empty

    return rows.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(meet, f"query_id {kind}, {schema}")


class _Block:
    """The posting rows of one block: entries of row r lie from ``bounds[r]`` to ``bounds[r + 1]``; ``code`` numbers the chunks of entries from 0 in the order of ``ids``."""

    def __init__(self, rows: pa.Table) -> None:
        self.rows, chunks = rows, rows["chunks"].combine_chunks()
        self.bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(chunks).to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.ids, self.code = np.unique(chunks.flatten().to_numpy(), return_inverse=True)
        self.ends = self.flat("ends").astype(np.int64)
        self.tf = np.diff(self.ends, prepend=0)
        begin = self.bounds[:-1][self.bounds[:-1] < self.bounds[1:]]
        self.tf[begin] = self.ends[begin]
        self._of: dict[str, np.ndarray] = {}

    def flat(self, column: str) -> np.ndarray:
        return self.rows[column].combine_chunks().flatten().to_numpy()

    def of(self, column: str) -> np.ndarray:
        """An entry's number that is the same in all entries of a chunk, by chunk; made once for all queries."""
        if column not in self._of:
            self._of[column] = np.zeros(len(self.ids), np.int64)
            self._of[column][self.code] = self.flat(column)
        return self._of[column]

    def places(self, row: int, entry: int) -> list[int]:
        if not hasattr(self, "_places"):
            lists = self.rows["places"].combine_chunks()
            self._places, self._from = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        end = self._from[row] + self.ends[entry]
        return self._places[end - self.tf[entry] : end].tolist()

    def holding(self, rows: np.ndarray) -> np.ndarray:
        """The chunks (by code) that stand in all of the rows."""
        n = np.zeros(len(self.ids), np.int64)
        for r in rows:
            n[self.code[self.bounds[r] : self.bounds[r + 1]]] += 1
        return np.flatnonzero(n == len(rows))


def _met(index: Index, asked: DataFrame) -> DataFrame:
    """(block, asked columns): the blocks that hold each asked term."""
    return index.postings(asked).select("block", "term").join(small(asked), "term")


def _best(score: np.ndarray, k: int | None) -> np.ndarray:
    """Places of the k best scores and of all that are as good within rounding (all with None); the exact cut follows in the plan."""
    if k is None or len(score) <= k:
        return np.arange(len(score))
    return np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k] - 1e-8)


def _holding(index: Index, asked: DataFrame) -> DataFrame:
    """(query_id, chunk_id, found: [(offset, term, places)]) of the chunks that hold every word of a query."""

    def each(held: _Block, right: pa.Table, i: int, j: int) -> dict | None:
        at = right["_at"].slice(i, j - i).to_numpy()
        rows = np.unique(at)
        if len(rows) < right["need"][i].as_py():
            return None
        codes = held.holding(rows)
        terms, offsets = right["term"].slice(i, j - i).to_pylist(), right["offset"].slice(i, j - i).to_pylist()
        found = [[] for _ in codes]
        for r, term, offset in zip(at, terms, offsets, strict=True):
            entry = np.full(len(held.ids), -1)
            entry[held.code[held.bounds[r] : held.bounds[r + 1]]] = np.arange(held.bounds[r], held.bounds[r + 1])
            for x, c in zip(found, codes, strict=True):
                x.append({"offset": offset, "term": term, "places": held.places(r, entry[c])})
        kind = pa.list_(pa.struct([("offset", pa.int32()), ("term", pa.string()), ("places", pa.list_(pa.int32()))]))
        return {"chunk_id": pa.array(held.ids[codes]), "found": pa.array(found, kind)}

    return _blocks(index, asked, _met(index, asked), ["places"], each, "chunk_id long, found array<struct<offset: int, term: string, places: array<int>>>")


def phrase_search(index: Index, queries: DataFrame, language: Column | None = None) -> DataFrame:
    """(query_id, chunk_id, hits, first): chunks that hold a query's words in its order and at its distances, how often, and the first place.

    Stop words of the query are not looked at but keep their room: "state of mind" finds "state x mind".  A query without
    other words finds nothing.
    """
    found = _holding(index, asked_terms(queries, language))
    begins = F.transform("found", lambda x: F.transform(x["places"], lambda p: p - x["offset"]))
    starts = F.aggregate(F.slice(begins, 2, F.size(begins)), F.element_at(begins, 1), lambda a, b: F.array_intersect(a, b))
    return found.select("query_id", "chunk_id", F.array_sort(starts).alias("s")).where(F.size("s") > 0).select("query_id", "chunk_id", F.size("s").alias("hits"), F.element_at("s", 1).alias("first"))


def near_search(index: Index, queries: DataFrame, distance: int, language: Column | None = None) -> DataFrame:
    """(query_id, chunk_id, span): chunks that hold all words of a query, in any order, within ``distance`` words from the first to the last; the smallest such span."""
    found = _holding(index, asked_terms(queries, language))
    lists = F.map_values(F.map_from_entries(F.array_distinct(F.transform("found", lambda x: F.struct(x["term"], x["places"])))))
    # from each place as the first: the next place of every term at or after it
    from_ = F.array_distinct(F.flatten(lists))
    ends = F.transform(from_, lambda p: F.struct(p.alias("p"), F.transform(lists, lambda l: F.array_min(F.filter(l, lambda q: q >= p))).alias("next")))
    spans = F.transform(F.filter(ends, lambda e: F.forall(e["next"], lambda q: q.isNotNull())), lambda e: F.array_max(e["next"]) - e["p"])
    return found.select("query_id", "chunk_id", F.array_min(spans).alias("span")).where(F.col("span") <= distance)


def text_matches(index: Index, queries: DataFrame, k: int | None = None) -> DataFrame:
    """What ``search.text_matches`` gives over the indexed chunks: (query_id, chunk_id, text_rank) of chunks that hold all words of a query.

    With ``k`` each block gives at least its k best for a query (ties to the smaller id), which hold the k best of all.
    """
    asked = asked_terms(queries).select("query_id", "term", "need").distinct()

    def each(held: _Block, right: pa.Table, i: int, j: int) -> dict | None:
        if j - i < right["need"][i].as_py():
            return None
        rows = right["_at"].slice(i, j - i).to_numpy()
        codes = held.holding(rows)
        if not len(codes):
            return None
        tf = np.zeros(len(held.ids), np.int64)
        for r in rows:
            tf[held.code[held.bounds[r] : held.bounds[r + 1]]] += held.tf[held.bounds[r] : held.bounds[r + 1]]
        n = held.of("ns")[codes]
        codes, n = (x[_best(tf[codes] / (1 + np.log(n)), k)] for x in (codes, n))
        return {"chunk_id": pa.array(held.ids[codes]), "tf": pa.array(tf[codes]), "n": pa.array(n)}

    found = _blocks(index, asked, _met(index, asked), ["ns"], each, "chunk_id long, tf long, n long")
    return found.select("query_id", "chunk_id", (F.col("tf") / (1 + F.ln("n"))).alias("text_rank"))


def _weighted(index: Index, queries: DataFrame, language: Column | None) -> DataFrame:
    """(query_id, term, weight): the distinct words of a query with their inverse document frequency times k1 + 1."""
    asked = asked_terms(queries, language).select("query_id", "term").distinct()
    idf = F.ln(1 + (index.facts["chunks"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return asked.join(index.terms(), "term").select("query_id", "term", (idf * (K1 + 1)).alias("weight"))


def bm25_bounds(index: Index, weighted: DataFrame) -> DataFrame:
    """(query_id, block, bound): what no chunk of a block can exceed; blocks without any of the words are not listed."""
    best = index.postings(weighted).select("term", "block", (F.col("most") / (F.col("most") + _room(index, F.col("least")))).alias("best"))  # a few short columns
    return best.join(small(weighted), "term").groupBy("query_id", "block").agg((F.sum(F.col("weight") * F.col("best")) * (1 + 1e-9)).alias("bound"))


def _room(index: Index, length: Column) -> Column:
    """What BM25 adds to a frequency below the fraction, by the chunk's length."""
    return K1 * (1 - B + B * length / max(index.facts["mean_length"], 1e-9))


def _scores(index: Index, weighted: DataFrame, pairs: DataFrame, k: int, some: bool = False) -> DataFrame:
    """(query_id, chunk_id, score) of the chunks of the (query_id, block) ``pairs``: at least the k best of each pair; ``some`` as in ``_blocks``."""
    wanted = weighted.join(pairs, "query_id").select("query_id", "term", "block", "weight")
    mean = max(index.facts["mean_length"], 1e-9)

    def each(held: _Block, right: pa.Table, i: int, j: int) -> dict | None:
        score, seen, length = np.zeros(len(held.ids)), np.zeros(len(held.ids), bool), held.of("lengths")
        for r, weight in zip(right["_at"].slice(i, j - i).to_numpy(), right["weight"].slice(i, j - i).to_numpy(), strict=True):
            code, tf = held.code[held.bounds[r] : held.bounds[r + 1]], held.tf[held.bounds[r] : held.bounds[r + 1]]
            score[code] += weight * tf / (tf + K1 * (1 - B + B * length[code] / mean))
            seen[code] = True
        codes = np.flatnonzero(seen)
        codes = codes[_best(score[codes], k)]
        return {"chunk_id": pa.array(held.ids[codes]), "score": pa.array(score[codes])}

    return _blocks(index, weighted, wanted, ["lengths"], each, "chunk_id long, score double", some).withColumn("score", F.round("score", 9))


def bm25(index: Index, queries: DataFrame, k: int, language: Column | None = None, seeds: int = SEEDS, told: dict | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best chunks that hold any word of a query, by BM25; exact, ties to the smaller id.

    Each query first reads the ``seeds`` blocks of best bound; its k-th score there rules out every other block whose bound is below,
    and only the rest is read.  ``told`` receives the (query, block) pairs in all, and those read.
    """
    work = Scratch(index.spark, "bm25")
    weighted = work.write(_weighted(index, queries, language), "weighted")
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    placed = work.write(bm25_bounds(index, weighted).withColumn("place", F.row_number().over(order)), "bounds")
    first = work.write(top(_scores(index, weighted, placed.where(F.col("place") <= seeds).select("query_id", "block"), k, True), k, "score", "chunk_id"), "seeded")
    least = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = placed.where(F.col("place") > seeds).join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-9))
    if told is not None:
        told["pairs"], told["read"] = placed.count(), rest.count() + placed.where(F.col("place") <= seeds).count()
    return top(_scores(index, weighted, rest.select("query_id", "block"), k).unionByName(first.drop("rank")), k, "score", "chunk_id")


def bm25_scan(chunks: DataFrame, queries: DataFrame, k: int, language: Column | None = None, size: int | None = None) -> DataFrame:
    """What ``bm25`` gives over an index of ``chunks`` (chunk_id, chunk_text, language), without one: the chunks are cut to words once, and only the words of the queries go on.

    Queries are dealt into groups, chunks into blocks, both of bounded size.  A block meets the words of each group and becomes one row of its places;
    frequencies and the mean length follow from these rows, and the scores from them and the weights.  ``size`` is about the bytes of all texts, where the
    caller knows it (else they are added up, which may cost as much as to make the chunks).
    """
    spark, work = chunks.sparkSession, Scratch(chunks.sparkSession, "bm25")
    pairs = work.write(asked_terms(queries, language).select("query_id", "term").distinct(), "asked")
    groups = max(1, -(-pairs.count() // PAIRS))
    pairs = pairs.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    texts = chunks.select("chunk_id", F.col("language").cast("string").alias("language"), F.coalesce(F.regexp_replace(F.lower("chunk_text"), r"[^\p{L}\p{N}]+", " "), F.lit("")).alias("t"))
    size = chunks.agg(F.sum(F.octet_length("chunk_text"))).first()[0] if size is None else size
    blocks = max(1, spark.sparkContext.defaultParallelism, -(-(size or 0) // BYTES))
    each = lambda df, name, n: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    left = each(texts.withColumn("block", F.pmod(F.xxhash64("chunk_id", "t"), F.lit(blocks)).cast("int")), "group", groups)
    right = each(pairs.select("group", "term").distinct(), "block", blocks)
    kinds = [x.schema[c].dataType.simpleString() for x, c in ((pairs, "query_id"), (texts, "chunk_id"))]
    schema = f"block int, group int, chunks long, tokens long, terms array<string>, dfs array<int>, ids array<{kinds[1]}>, lengths array<int>, rows array<int>, tfs array<int>"
    met = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(_scanned, schema)
    met.write.option("maxRecordsPerFile", ROWS).parquet(work.at("blocks"))  # a file is read as a whole
    rows = spark.read.schema(met.schema).parquet(work.at("blocks"))
    told = rows.where("group = 0").agg(F.coalesce(F.sum("chunks"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    mean = max(told[1] / max(told[0], 1), 1e-9)
    df = rows.select("group", F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("group", F.col("x.terms").alias("term")).agg(F.sum("x.dfs").alias("df"))
    idf = F.ln(1 + (told[0] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = pairs.join(df, ["group", "term"]).select("group", F.struct("query_id", "term", (idf * (K1 + 1)).alias("weight")).alias("x"))
    packed = weighted.groupBy("group").agg(F.array_sort(F.collect_list("x")).alias("asked"))
    packed = F.broadcast(packed) if groups <= FEW_GROUPS else each(packed, "block", blocks)  # at most PAIRS short rows each
    met = rows.select("block", "group", "terms", "dfs", "ids", "lengths", "rows", "tfs").join(packed, ["group"] if groups <= FEW_GROUPS else ["block", "group"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                terms, dfs, ids, lengths, at, tfs, asked = (batch.column(c)[i].values for c in ("terms", "dfs", "ids", "lengths", "rows", "tfs", "asked"))
                query, term, weight = (asked.field(c) for c in ("query_id", "term", "weight"))
                held = pc.index_in(term, terms)
                stay = pc.is_valid(held)
                query, held, weight = query.filter(stay), held.filter(stay).to_numpy(), weight.filter(stay).to_numpy()
                if not len(held):
                    continue
                at, tfs, ends = at.to_numpy(), tfs.to_numpy(), np.cumsum(dfs.to_numpy())
                part = tfs / (tfs + K1 * (1 - B + B * lengths.to_numpy()[at] / mean))
                edges = np.flatnonzero(np.asarray(pc.not_equal(query[1:], query[:-1]), bool)) + 1
                firsts, places, found = [0, *edges.tolist()], [], []
                for a, b in zip(firsts, [*firsts[1:], len(held)], strict=True):
                    total = np.zeros(len(ids))
                    for t, w in zip(held[a:b].tolist(), weight[a:b].tolist(), strict=True):
                        x = slice(ends[t - 1] if t else 0, ends[t])
                        total[at[x]] += w * part[x]
                    best = np.flatnonzero(total)
                    best = _first_alike(best[_best(total[best], k)], total, ids, k)
                    places.append(best)
                    found.append(total[best])
                many = np.repeat(firsts, [len(x) for x in places])
                yield pa.RecordBatch.from_arrays([query.take(pa.array(many)), ids.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(found))], names=["query_id", "chunk_id", "score"])

    scored = met.select("terms", "dfs", "ids", "lengths", "rows", "tfs", "asked").mapInArrow(score, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")
    return top(scored.withColumn("score", F.round("score", 9)), k, "score", "chunk_id")


def _scanned(block: pa.Table, group: pa.Table) -> pa.Table:
    """One row of a block of chunks (chunk_id, language, t: words parted by blanks) and a group of words (term): the words that stand in it one after the other, with the chunks that hold them (as places in ``ids``) and how often.

    ``lengths`` counts a chunk's words that are no stop words of its language, ``tokens`` adds them up; ``chunks`` counts the chunks.
    """
    keys = next(x for x in (block, group) if x.num_rows)
    ids, language, texts = (block.column(c).combine_chunks() for c in ("chunk_id", "language", "t"))
    terms, n = group.column("term").combine_chunks(), max(1, len(ids))
    parted = pc.split_pattern(texts, " ")
    row = np.repeat(np.arange(len(ids)), pc.list_value_length(parted).to_numpy(zero_copy_only=False))
    flat = parted.flatten()
    dropped = np.asarray(pc.equal(flat, ""), bool)
    for k, words_ in LANGUAGES.items():
        dropped |= np.asarray(pc.is_in(flat, pa.array(words_)), bool) & np.asarray(pc.fill_null(pc.equal(language, k), False), bool)[row]
    lengths = np.bincount(row[~dropped], minlength=len(ids))
    at = pc.index_in(flat, terms)
    has = np.flatnonzero(np.asarray(pc.is_valid(at), bool))
    entry = np.sort(np.asarray(at.take(pa.array(has))).astype(np.int64) * n + row[has])
    first = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])) if len(entry) else np.zeros(0, np.int64)
    tfs, entry = np.diff(np.append(first, len(entry))), entry[first]
    df = np.bincount(entry // n, minlength=len(terms))
    held = np.flatnonzero(df)

    def one(x: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)

    ints = [one(pa.array(x, pa.int32())) for x in (df[held], lengths, entry % n, tfs)]
    return pa.table(
        [keys.column("block")[:1], keys.column("group")[:1], pa.array([len(ids)]), pa.array([int(lengths.sum())]), one(terms.take(pa.array(held))), ints[0], one(ids), *ints[1:]],
        ["block", "group", "chunks", "tokens", "terms", "dfs", "ids", "lengths", "rows", "tfs"],
    )


def _first_alike(places: np.ndarray, score: np.ndarray, ids: pa.Array, k: int) -> np.ndarray:
    """Of places with the very same score no more than k, those of the smallest ids."""
    if len(places) <= k or not pa.types.is_integer(ids.type) or ids.null_count:
        return places
    places = places[np.lexsort((ids.to_numpy()[places], score[places]))]
    same = np.concatenate([[False], score[places[1:]] == score[places[:-1]]])
    at = np.arange(len(places))
    return places[at - np.maximum.accumulate(np.where(same, 0, at)) < k]
