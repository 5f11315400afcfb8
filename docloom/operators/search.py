"""Vector, text and hybrid search; similar documents; context assembly.  Queries come in tables, so batches are one plan."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as t
from docloom.sources.shared import Scratch

# Weights (vector, text) and threshold of each kind of caller.
DEFAULTS = {"service": (0.7, 0.3, 0.5), "config": (0.6, 0.4, 0.7), "history": (0.5, 0.5, None), "similar": (0.9, 0.1, 0.6)}
#: Vectors of one block in a comparison of documents.
BLOCK = 2048
#: Vectors, and queries, that meet in one group (about as many, being dealt by hash), and numbers in either; the fewest vectors worth a group of their own; pairs that a group returns.
SIDE, NUMBERS, LEAST, PAIRS = 16_384, 1 << 22, 512, 500_000
#: Queries of a group that are scored at once.
STRIPE = 32
#: Lexemes of all queries that a scan looks for at once.
FEW = 2000
#: Beyond: texts and queries of one group, bytes of either, and pairs that are checked at once.
TEXTS, ASKED, BYTES, TOGETHER = 16_384, 65_536, 1 << 25, 1 << 21
# English stop words of the text search.
STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with")


def lexemes(c: Column, stop: tuple[str, ...] = STOP) -> Column:
    """Lower-case words of letters and digits without stop words (no stemming: word forms stay apart)."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: ~w.isin(*stop))


def small(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """A table with a broadcast hint if it has at most ``limit`` short rows; beyond, joins shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def top(df: DataFrame, k: int | None, score: str, key: str, by: str = "query_id") -> DataFrame:
    """The k best rows of each query (partial top-k before the shuffle; all with None), with ``rank``."""
    w = Window.partitionBy(by).orderBy(F.desc(score), key)
    ranked = df.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def vector_hits(vectors: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, inclusive: bool = False) -> DataFrame:
    """(query_id, chunk_id, similarity, rank) of ``queries`` (query_id, q) against ``vectors`` (chunk_id, embedding).

    The stated queries meet all rows block by block, and each block keeps the k best of each query.
    """
    return top(block_scores(vectors, queries, k, threshold, inclusive), k, "similarity", "chunk_id")


def unit_rows(rows: pa.Array) -> np.ndarray:
    """The vectors of one block at length 1 (a zero vector stays zero, so its cosine is 0); vectors of different length are an error."""
    if len(set(pc.list_value_length(rows).to_pylist())) > 1:
        raise ValueError("vectors differ in length")
    x = np.asarray(rows.flatten().to_numpy(zero_copy_only=False), float).reshape(len(rows), -1)
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _shared(query_pages: list[int] | None, pages: pa.Array) -> np.ndarray:
    """Which lists of pages hold one of the query's."""
    flat, sizes = pages.flatten(), pc.fill_null(pc.list_value_length(pages), 0).to_numpy(zero_copy_only=False)
    hit = np.isin(flat.to_numpy(zero_copy_only=False), query_pages or [])
    return np.isin(np.arange(len(pages)), np.repeat(np.arange(len(pages)), sizes)[hit])


def block_scores(vectors: DataFrame, queries: DataFrame, k: int | None, threshold: float | None = None, inclusive: bool = False, boost: float | None = None) -> DataFrame:
    """(query_id, chunk_id, similarity to nine places): of each query and block of vectors the k best (all with None) that pass the threshold.

    Vectors and queries are dealt by hash into blocks and chunks of bounded size, and each block meets each chunk in a group of its own, so that
    a group is as large at any table size and length of vectors; all vectors have one length (else an error).  With ``boost`` both sides have ``pages``, and a vector
    that covers a page of the query gains so much before the k best are taken.
    """
    n, one = vectors.count(), vectors.where("embedding is not null").select(F.size("embedding")).first()
    side = min(SIDE, max(1, NUMBERS // max(1, one[0] if one else 1)))
    blocks = max(1, -(-n // side), min(vectors.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST)))
    chunks = max(1, -(-queries.count() // min(side, PAIRS // min(side, max(1, side if k is None else k)))))

    def dealt(df: DataFrame, key: str, vector: str, own: str, parts: int, other: str, others: int) -> DataFrame:
        pages = F.lit(None).cast("array<int>") if boost is None else F.col("pages").cast("array<int>")
        rows = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("row"), pages.alias("pages"))
        placed = rows.withColumn(own, F.pmod(F.xxhash64("key", "row"), F.lit(parts)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    def score(block: pa.Table, chunk: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if block.num_rows and chunk.num_rows:
            (keys, rows, pages), (query_keys, query_rows, query_pages) = ([x.column(c).combine_chunks() for c in ("key", "row", "pages")] for x in (block, chunk))
            keys, query_keys, rows, asked = keys.to_numpy(), query_keys.to_numpy(), unit_rows(rows), unit_rows(query_rows)
            if rows.shape[1] != asked.shape[1]:
                raise ValueError("vectors differ in length")
            for first in range(0, len(asked), STRIPE):
                for q, s in enumerate(np.round(asked[first : first + STRIPE] @ rows.T, 9) + 0.0, first):
                    if boost is not None:
                        s += boost * _shared(query_pages[q].as_py(), pages)
                    at = np.arange(len(keys)) if threshold is None else np.flatnonzero(s >= threshold if inclusive else s > threshold)
                    if k is not None and len(at) > k:
                        least = np.partition(s[at], len(at) - k)[len(at) - k]
                        at = at[s[at] >= least]
                        at = at[np.lexsort((keys[at], -s[at]))[:k]]
                    out.append((np.full(len(at), query_keys[q]), keys[at], s[at]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query_id", "chunk_id", "similarity"])

    left = dealt(vectors, "chunk_id", "embedding", "block", blocks, "chunk", chunks).groupBy("block", "chunk")
    right = dealt(queries, "query_id", "q", "chunk", chunks, "block", blocks).groupBy("block", "chunk")
    return left.cogroup(right).applyInArrow(score, "query_id long, chunk_id long, similarity double")


def document_pair_similarity(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(d1, d2, similarity): the largest cosine (0 at least) between the vectors (document_id, embedding) of each stated pair (d1, d2) of documents, block by block."""
    named = vectors.select("document_id", F.col("embedding").cast("array<double>").alias("embedding")).where("document_id is not null and embedding is not null")

    def pack(batches):
        for batch in batches:
            docs = np.asarray(batch.column(0))
            for d in np.unique(docs).tolist():
                rows = batch.column(1).take(pa.array(np.flatnonzero(docs == d)))
                for at in range(0, len(rows), BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([rows.slice(at, BLOCK).to_pylist()], pa.list_(pa.list_(pa.float64())))], ["document_id", "rows"])

    packed = named.mapInArrow(pack, "document_id long, rows array<array<double>>")
    a, b = (packed.select(F.col("document_id").alias(d), F.col("rows").alias(r)) for d, r in (("d1", "rows1"), ("d2", "rows2")))
    met = a.join(small(pairs.select("d1", "d2").distinct()), "d1").join(b, "d2").select("d1", "d2", "rows1", "rows2")

    def best(batches):
        for batch in batches:
            most = [float((unit_rows(batch.column(2)[i].values) @ unit_rows(batch.column(3)[i].values).T).max()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(most, pa.float64())], ["d1", "d2", "s"])

    return met.mapInArrow(best, "d1 long, d2 long, s double").groupBy("d1", "d2").agg(F.greatest(F.max("s"), F.lit(0.0)).alias("similarity"))


def text_matches(chunks: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, chunk_id, text_rank): every chunk that holds all lexemes of a query, unranked; with ``k`` at least the k best of each query.

    Rank is the sum of the lexemes' frequencies in the chunk (chunk_id, chunk_text) over ``1 + ln(length)``.  Where the queries have few lexemes in all,
    the chunks are read once and only those lexemes go on: chunks meet a query at its rarest lexeme and are then checked for all others.
    Else blocks of chunks meet groups of queries (``_block_matches``).
    """
    work = Scratch(chunks.sparkSession, "lexemes")
    asked = work.write(queries.select("query_id", F.array_distinct(lexemes(F.col("query"))).alias("l")).where(F.size("l") > 0), "asked")  # read several times
    each = asked.select("query_id", F.explode("l").alias("term"))
    few = [r["term"] for r in each.select("term").distinct().limit(FEW + 1).collect()]
    if len(few) > FEW:
        found = _block_matches(chunks, asked, k)
        return found.select("query_id", "chunk_id", (F.col("tf") / (1 + F.ln("n"))).alias("text_rank"))
    wanted = small(each.select("term").distinct(), 1_000_000)
    terms = chunks.select("chunk_id", lexemes(F.col("chunk_text")).alias("own")).withColumn("n", F.size("own"))
    met_some = terms.withColumn("own", F.filter("own", lambda w: w.isin(few))).where(F.size("own") > 0)
    terms = work.write(met_some, "met")
    df = terms.select(F.explode(F.array_distinct("own")).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    # a term that no chunk holds is the rarest: its query drops out with it
    rarest = each.join(df, "term", "left").groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    keyed = asked.join(rarest, "query_id")
    met = terms.select("chunk_id", "own", "n", F.explode(F.array_distinct("own")).alias("term")).join(small(rarest.select("term").distinct(), 1_000_000), "term", "left_semi").join(small(keyed), "term")
    whole = met.where(F.size(F.array_except("l", "own")) == 0)
    tf = F.size(F.filter("own", lambda w: F.array_contains(F.col("l"), w)))
    return whole.select("query_id", "chunk_id", (tf / (1 + F.ln("n"))).alias("text_rank"))


def _block_matches(chunks: DataFrame, asked: DataFrame, k: int | None) -> DataFrame:
    """(query_id, chunk_id, tf, n) of the chunks that hold all of a query's lexemes ``l``: their frequencies added up, and the chunk's lexemes; with ``k`` each group gives at least its k best of a query.

    The chunks are read once, cut to words and dealt by hash into blocks, the queries into groups, both of bounded size; a block meets each group once.
    """
    spark = chunks.sparkSession
    # the lexemes of a text, of a query or of a chunk (stop words still among them), parted by one blank
    packed = asked.select(F.col("query_id").alias("key"), F.array_join(F.array_sort("l"), " ").alias("t"))
    texts = chunks.select(F.col("chunk_id").alias("key"), F.col("chunk_text").alias("t")).where("t is not null")
    told = [x.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first() for x in (texts, packed)]
    blocks = max(1, -(-told[0][0] // TEXTS), -(-told[0][1] // BYTES), min(spark.sparkContext.defaultParallelism, -(-told[0][0] // LEAST)))
    groups = max(1, -(-told[1][0] // ASKED), -(-told[1][1] // BYTES))
    texts = texts.withColumn("t", F.regexp_replace(F.lower("t"), r"[^\p{L}\p{N}]+", " "))
    kinds = [x.schema["key"].dataType.simpleString() for x in (packed, texts)]

    def dealt(df: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        placed = df.withColumn(own, F.pmod(F.xxhash64("key", "t"), F.lit(parts)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).groupBy("block", "group")

    def meet(block: pa.Table, group: pa.Table) -> pa.Table:
        (ids, body), (query_ids, query) = ([x.column(c).combine_chunks() for c in ("key", "t")] for x in (block, group))
        q, row, tf, n = held_together(body, query, ids, k)
        return pa.table([query_ids.take(pa.array(q)), ids.take(pa.array(row)), pa.array(tf), pa.array(n)], ["query_id", "chunk_id", "tf", "n"])

    return dealt(texts, "block", blocks, "group", groups).cogroup(dealt(packed, "group", groups, "block", blocks)).applyInArrow(meet, f"query_id {kinds[0]}, chunk_id {kinds[1]}, tf long, n long")


def held_together(texts: pa.Array, queries: pa.Array, ids: pa.Array, k: int | None) -> tuple[np.ndarray, ...]:
    """(query, text, frequencies, lexemes of the text) of the texts that hold all words of a query, as places in the arrays; words are parted by blanks, a query's are distinct.

    A query starts from the texts that hold its rarest word and drops those without the next, all queries at once.  With ``k`` at least the k best of a
    query stay, and of those alike in frequencies and length no more than k, those of the smallest ``ids``.
    """
    alike = queries.dictionary_encode()  # the same query is answered once
    each = pc.split_pattern(alike.dictionary, " ")
    need = pc.list_value_length(each).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = each.flatten().dictionary_encode()
    term, rows = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(texts))
    none = (np.zeros(0, np.int64),) * 4
    if not len(term):
        return none
    parted = pc.split_pattern(texts, " ")
    size = pc.list_value_length(parted).to_numpy(zero_copy_only=False).astype(np.int64)
    row, flat = np.repeat(np.arange(len(size)), size), parted.flatten()
    n = size - np.bincount(row[np.asarray(pc.is_in(flat, pa.array(["", *STOP])), bool)], minlength=len(size))
    at = pc.index_in(flat, coded.dictionary)
    has = np.flatnonzero(np.asarray(pc.is_valid(at), bool))
    entry = np.sort(np.asarray(at.take(pa.array(has))).astype(np.int64) * rows + row[has])
    del row, flat, at, has, parted
    if not len(entry):
        return none
    first = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
    often, entry = np.diff(np.append(first, len(entry))), entry[first]  # a word in a text, and how often
    df = np.bincount(entry // rows, minlength=len(coded.dictionary))
    begin = np.cumsum(df) - df
    start = np.cumsum(need) - need
    term = term[np.lexsort((df[term], np.repeat(np.arange(len(need)), need)))]  # a query's words, rarest first
    met = df[term[start]]
    asked = np.flatnonzero(met)
    stripe = np.cumsum(met[asked]) // TOGETHER
    found = []
    for some in np.split(asked, np.flatnonzero(stripe[1:] != stripe[:-1]) + 1):
        many = met[some]
        q = np.repeat(some, many)
        place = np.repeat(begin[term[start[some]]] - (np.cumsum(many) - many), many) + np.arange(len(q))
        r, tf = entry[place] % rows, often[place]
        for t_ in range(1, int(need[some].max())):
            more = np.flatnonzero(need[q] > t_)
            if not len(more):
                break
            sought = term[start[q[more]] + t_] * rows + r[more]
            place = np.minimum(np.searchsorted(entry, sought), len(entry) - 1)
            hit = entry[place] == sought
            tf[more] += often[place]  # of those without the word too: they go
            stay = np.ones(len(q), bool)
            stay[more[~hit]] = False
            q, r, tf = q[stay], r[stay], tf[stay]
        found.append(_leading(q, r, tf, n[r], ids, k))
    q, r, tf = (np.concatenate(x) for x in zip(*found, strict=True))
    # each asker of a query gets its texts
    many, code = np.bincount(q, minlength=len(need)), alike.indices.to_numpy(zero_copy_only=False)
    where, of = (np.cumsum(many) - many)[code], many[code]
    place = np.repeat(where - (np.cumsum(of) - of), of) + np.arange(of.sum())
    return np.repeat(np.arange(len(code)), of), r[place], tf[place], n[r[place]]


def _leading(q: np.ndarray, r: np.ndarray, tf: np.ndarray, n: np.ndarray, ids: pa.Array, k: int | None) -> tuple[np.ndarray, ...]:
    """(query, text, frequencies) in order of the query; with ``k`` what may be among its k best: the exact cut, with the plan's own logarithm, follows there."""
    if k is None or not len(q):
        return q, r, tf
    score = tf / (1 + np.log(n))
    sortable = pa.types.is_integer(ids.type) and not ids.null_count
    order = np.lexsort((ids.to_numpy()[r] if sortable else r, n, tf, -score, q))
    q, r, tf, n, score = (x[order] for x in (q, r, tf, n, score))
    new = np.concatenate([[True], q[1:] != q[:-1]])
    group = np.concatenate([[True], (q[1:] != q[:-1]) | (tf[1:] != tf[:-1]) | (n[1:] != n[:-1])])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(q)))
    least = np.where(size >= k, score[np.minimum(begin + k - 1, len(q) - 1)], -np.inf)
    stay = score >= np.repeat(least, size) - 1e-8
    if sortable:
        stay &= np.arange(len(q)) - np.maximum.accumulate(np.where(group, np.arange(len(q)), 0)) < k
    return q[stay], r[stay], tf[stay]


def text_hits(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, text_rank, rank): the k best of ``text_matches``."""
    return top(text_matches(chunks, queries, k), k, "text_rank", "chunk_id")


def fuse(vector: DataFrame, text: DataFrame, k: int, weights: tuple[float, float]) -> DataFrame:
    """Full outer merge of both hit lists: combined = similarity * wv + text_rank * wt, the k best with rank and search_types."""
    v = vector.select("query_id", "chunk_id", "similarity")
    x = text.select("query_id", "chunk_id", "text_rank")
    both = v.join(x, ["query_id", "chunk_id"], "full_outer")
    combined = F.coalesce("similarity", F.lit(0.0)) * weights[0] + F.coalesce("text_rank", F.lit(0.0)) * weights[1]
    types = F.array_compact(F.array(F.when(F.col("similarity").isNotNull(), F.lit("vector")), F.when(F.col("text_rank").isNotNull(), F.lit("text"))))
    return top(both.withColumn("combined", combined).withColumn("search_types", types), k, "combined", "chunk_id")


def fuse_sum(hits: DataFrame, k: int) -> DataFrame:
    """Union form of the merge: (query_id, chunk_id, score) rows add up by chunk."""
    return top(hits.groupBy("query_id", "chunk_id").agg(F.sum("score").alias("combined")), k, "combined", "chunk_id")


def retrieve(scored: DataFrame, threshold: float = 0.3, k: int = 5, fallback: int = 3) -> DataFrame:
    """Per query the k best at or above the threshold, or the ``fallback`` best where none reaches it."""
    ranked = top(scored, k, "similarity", "chunk_id")
    best = Window.partitionBy("query_id")
    any_pass = F.max((F.col("similarity") >= threshold).cast("int")).over(best) == 1
    return ranked.withColumn("p", any_pass).where(F.when(F.col("p"), F.col("similarity") >= threshold).otherwise(F.col("rank") <= fallback)).drop("p")


def page_boosted_hits(vectors: DataFrame, queries: DataFrame, k: int, boost: float = 0.1) -> DataFrame:
    """(query_id, chunk_id, boosted, rank): the k best of ``vectors`` (chunk_id, embedding, pages) for ``queries`` (query_id, q, query), where a chunk gains that covers a page which the query names."""
    asked = queries.withColumn("pages", t.pages_of_query(F.col("query")))
    return top(block_scores(vectors, asked, k, boost=boost).withColumnRenamed("similarity", "boosted"), k, "boosted", "chunk_id")


def first_per_document(hits: DataFrame) -> DataFrame:
    """The best-ranked hit of each document, in rank order."""
    w = Window.partitionBy("query_id", "document_id").orderBy("rank")
    return hits.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def context(hits: DataFrame) -> DataFrame:
    """(query_id, context): ranked chunks (rank, filename, section_title, page_numbers, chunk_text) as one prompt text."""
    pages = F.array_join(F.col("page_numbers").cast("array<string>"), ", ")
    lines = F.array_compact(F.array(
        F.concat(F.lit("Document: "), F.col("filename")), F.when(F.col("section_title").isNotNull(), F.concat(F.lit("Section: "), F.col("section_title"))),
        F.when(F.size("page_numbers") > 0, F.concat(F.lit("Page(s): "), pages)), F.concat(F.lit("Content: "), F.col("chunk_text")), F.lit("---"),
    ))
    each = hits.select("query_id", F.struct("rank", F.array_join(lines, "\n").alias("text")).alias("b"))
    return each.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["text"]), "\n").alias("context"))


def reference(filename: Column, pages: Column, section: Column) -> Column:
    """One line of a reference list."""
    some = F.when(F.size(pages) > 0, F.concat(F.lit(" (Page(s): "), F.array_join(pages.cast("array<string>"), ", "), F.lit(")"))).otherwise("")
    return F.concat(F.lit("• "), filename, some, F.when(section.isNotNull(), F.concat(F.lit(" - Section: "), section)).otherwise(""))


def similar_query(content: Column, filename: Column, n: int = 50) -> Column:
    """The query that stands for a document: its first words, else its file name."""
    first = F.array_join(F.slice(t.words(content), 1, n), " ")
    return F.when(F.length(first) > 0, first).otherwise(filename)


def readable(matches: DataFrame, documents: DataFrame, k: int, before: bool = False) -> DataFrame:
    """Ranked matches (query_id, user_id, document_id, chunk_id, text_rank) that their asker may read: documents (document_id, owner), own ones or all where ``user_id`` is null.

    The check follows the cut to ``k`` (so fewer may come back), or precedes it with ``before``; ``rank`` is the place among all matches
    of the query either way.  No query's matches are sorted as a whole: the few that stay are placed by counting those ahead of them.
    """
    may = F.col("user_id").isNull() | (F.col("owner") == F.col("user_id"))
    owners = documents.select("document_id", "owner")
    if not before:
        return top(matches, k, "text_rank", "chunk_id").join(owners, "document_id").where(may).drop("owner")
    stay = top(matches.join(owners, "document_id").where(may).drop("owner"), k, "text_rank", "chunk_id").drop("rank")
    mine = small(stay.select("query_id", F.col("chunk_id").alias("_c"), F.col("text_rank").alias("_r")))
    ahead = (F.col("text_rank") > F.col("_r")) | ((F.col("text_rank") == F.col("_r")) & (F.col("chunk_id") <= F.col("_c")))
    places = matches.select("query_id", "chunk_id", "text_rank").join(mine, "query_id").groupBy("query_id", "_c").agg(F.count_if(ahead).cast("int").alias("rank"))
    return stay.join(places.withColumnRenamed("_c", "chunk_id"), ["query_id", "chunk_id"])


def similar_documents(vector: DataFrame, text: DataFrame, recent: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, document_id, score, search_types, rank): documents like the asking one (query_id is its id), itself left out.

    ``vector`` and ``text`` are hits (query_id, chunk_id = document id, similarity or text_rank); they are fused .9 to .1, twice ``k``
    are fetched, those of at least .6 combined stay.  A document without any gets the ``recent`` documents (document_id, place) with score .5.
    """
    weights = DEFAULTS["similar"]
    fused = fuse(vector, text, 2 * k, weights[:2]).where((F.col("combined") >= weights[2]) & (F.col("chunk_id") != F.col("query_id")))
    order = Window.partitionBy("query_id").orderBy("rank")
    found = fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("chunk_id").alias("document_id"), F.col("combined").alias("score"), "search_types", "rank")
    asked = vector.select("query_id").unionByName(text.select("query_id")).distinct()
    lone = asked.join(found.select("query_id").distinct(), "query_id", "left_anti").join(F.broadcast(recent.where(F.col("place") <= k + 1)), F.col("document_id") != F.col("query_id"))  # at most k + 1 rows
    spare = lone.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).where(F.col("rank") <= k)
    return found.unionByName(spare.select("query_id", "document_id", F.lit(0.5).alias("score"), F.array().cast("array<string>").alias("search_types"), "rank"))


def search_analytics(searches: DataFrame) -> DataFrame:
    """Per search type: searches, mean response time and results (0 without any)."""
    return searches.groupBy("search_type").agg(F.count("*").alias("searches"), F.coalesce(F.avg("response_time_ms"), F.lit(0.0)).alias("avg_ms"), F.coalesce(F.avg("result_count"), F.lit(0.0)).alias("avg_results"))
