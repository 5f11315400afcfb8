"""Near-duplicate groups: MinHash bands with sequential Bayesian verification (operator 5).

Documents become sets of distinct word shingles; two are linked where ``100 * |A & B| >= percent * |A | B|``.

1. One pass over the texts makes a digest of each set, MinHash band keys and a signature (16 bits per hash).
   Equal sets collapse to one representative (the smallest id), so copies cost nothing later.
2. Band keys that two representatives share are buckets.  In each bucket one leader, the member that sits in the
   largest buckets over all bands (the origin of a group of near copies does), is compared with the others:
   candidates grow with the bucket, not with its square.
3. Candidates are verified in batches of signature values: after each batch a pair is dropped if the posterior
   probability (uniform prior) that its similarity reaches the threshold is below ``miss``.  Survivors are verified
   on their full shingle sets (64-bit shingle hashes).
4. Links make components.  A bucket whose members lie in several components still hides untried pairs.  Their texts meet
   at rare shingles: in an order of all shingles, rarest first, two sets that reach the similarity share one of the
   first few, how many depends on both sizes.  Pairs that meet there, of different components, with enough shingles
   left to reach the similarity, go through the same Bayesian test and are verified on full sets.  So every pair of a
   bucket that could still join two components is tried, and texts that have only frequent shingles in common (pages
   of one template) do not meet.

Work grows with the bands and shingles of the documents and with the pairs that meet.  Pairs within one component are
never listed; what meets at one rare shingle without belonging together is compared in cells of bounded size.

With 32 bands of 5 hashes a pair at similarity 0.8 misses all buckets with probability 3e-6.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import _words
from docloom.llm._spark import Workspace, binary, fresh, hinted, long, longs, map_batches
from docloom.llm.components import connected_components

BANDS, ROWS = 32, 5
#: Signature values compared between two decisions of the Bayesian test.
BATCH = 32
#: Members of one side of a block.
BLOCK = 256
#: Ratio of neighbouring size classes of the prefix filter, and holders of a shingle at which they meet whatever their sizes.
CLASS, LIGHT = 1.02, 64
#: Bound of the shingles that are sent everywhere as frequent ones (some 30 bytes each).
HOT = 50_000


def shingle_sets(text: _words.Words, n: int) -> list[np.ndarray]:
    """Each document's distinct shingle hashes, ascending; with fewer than ``n`` words the whole sequence is one."""
    h = text.hashes()
    ix, doc = _words.window_starts(text.first, n)
    keys = _words.windows(h, n)[ix]
    cuts = np.searchsorted(doc, np.arange(len(text.first)))
    out = []
    for k, words in enumerate(text.counts.tolist()):
        if words >= n:
            out.append(np.unique(keys[cuts[k] : cuts[k + 1]]))
        elif words:
            s = text.first[k]
            out.append(_words.windows(h[s : s + words], words))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def multipliers(count: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, a: np.ndarray) -> np.ndarray:
    """MinHash values under the multiplicative hashes ``a``, a bounded stretch of shingles at a time."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 256):
        np.minimum(out, (shingles[k : k + 256, None] * a).min(0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for r in range(rows):
        h = _words.mix(h ^ sig.reshape(bands, rows)[:, r])
    return h


def least_matches(total: int, percent: int, miss: float) -> list[tuple[int, int]]:
    """(values compared, matches needed to go on): with fewer, P(similarity >= percent / 100 | matches) < miss.

    The posterior under a uniform prior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum.
    """
    t, out = percent / 100, []
    for n in range(BATCH, total + 1, BATCH):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                out.append((n, m))
                break
    return out


def plausible(x: np.ndarray, y: np.ndarray, tests: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the rows of two signature matrices that pass every batch of the test."""
    alive, matches, done = np.arange(len(x)), np.zeros(len(x), np.int64), 0
    for n, least in tests:
        matches = matches + (x[alive, done:n] == y[alive, done:n]).sum(1)
        keep = matches >= least
        alive, matches, done = alive[keep], matches[keep], n
    return alive


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A matrix of 16-bit values from a column of equally long binaries."""
    column = column.cast(pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]].view("<u2").reshape(-1, width)


def near_duplicates(
    docs: DataFrame, n: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, miss: float = 1e-5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id`` (smallest id reachable over links), ``kept`` (that is the own id).

    Null and empty texts, and texts without words, have no shingles and no links.  Copies and repeated rows link like
    any pair; rows that share an id are one document with several texts.  A row without id links with nothing, has a
    null component and is kept.  Texts of any length count whole, a long one in a pass of its own.  An empty table gives
    an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "neardup")
    width = bands * rows
    key = T.StructField("id", docs.schema[id_col].dataType, True)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    a = multipliers(width)

    def sketch(batch: pa.RecordBatch):
        for s, e, text in _words.batch_words(batch, "text", _words.NONSPACE):
            sets = shingle_sets(text, n)
            sigs = [signature(x, a) if len(x) else None for x in sets]
            yield {
                "id": batch.column(0).slice(s, e - s),
                "n_shingles": [len(x) for x in sets],
                "digest": pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()),
                "bands": pa.array([None if g is None else band_keys(g, bands, rows).view(np.int64) for g in sigs], pa.list_(pa.int64())),
                "sig": pa.array([None if g is None else g.astype("<u2").tobytes() for g in sigs], pa.binary()),
            }

    sketches = work.write(map_batches(texts, [key, long("n_shingles"), binary("digest"), longs("bands"), binary("sig")], sketch), "sketches")
    known = sketches.where("digest is not null and id is not null")
    copies = work.write(known.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").select("digest", "rep"), "copies")
    members = work.write(
        sketches.select("id", "n_shingles", "digest").join(copies, "digest", "left").select("id", "n_shingles", F.when(F.col("digest").isNotNull(), F.coalesce("rep", "id")).alias("rep")), "members"
    )
    # texts of one id: their representatives belong together
    several = members.where("rep is not null and id is not null").groupBy("id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).where("u < v").select("u", "v")
    same_id = work.write(several, "same-id")

    distinct = known.join(copies, "digest", "left").where("rep is null or rep = id").select("id", F.explode("bands").alias("key"))
    keys = work.write(distinct, "keys")
    shared = work.write(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    buckets = work.write(keys.join(shared, "key"), "buckets")
    work.drop("keys", "shared")
    weight = buckets.groupBy("id").agg(F.sum("size").alias("weight"))
    leaders = work.write(buckets.join(weight, "id").groupBy("key").agg(F.max_by("id", F.struct("weight", "id")).alias("leader")), "leaders")
    pairs = buckets.join(leaders, "key").where("id != leader").select(F.least("id", "leader").alias("x"), F.greatest("id", "leader").alias("y")).distinct()
    sigs = work.write(sketches.select("id", "sig").join(buckets.select("id").distinct(), "id", "left_semi").where("sig is not null").dropDuplicates(["id", "sig"]), "sigs")
    tests = least_matches(width, percent, miss)

    def pass_test(batch: pa.RecordBatch):
        alive = pa.array(plausible(_matrix(batch.column(2), width), _matrix(batch.column(3), width), tests))
        yield {"x": batch.column(0).take(alive), "y": batch.column(1).take(alive)}

    pair_fields = [T.StructField(c, key.dataType, True) for c in ("x", "y")]

    def tested(found: DataFrame) -> DataFrame:
        """The pairs that pass the Bayesian test."""
        with_sigs = (
            found.join(sigs.select(F.col("id").alias("x"), F.col("sig").alias("sx")), "x")
            .join(sigs.select(F.col("id").alias("y"), F.col("sig").alias("sy")), "y").select("x", "y", "sx", "sy")
        )
        return map_batches(with_sigs, pair_fields, pass_test)

    likely = work.write(tested(work.write(pairs, "pairs")), "likely")
    links = work.write(_verified(work, texts, likely, key, n, percent, "first").unionByName(same_id), "links")
    components = work.write(connected_components(work, links, "cc1"), "components1")

    untried = _untried(work, buckets, components, texts, key, n, percent)
    more = work.write(tested(untried.join(likely, ["x", "y"], "left_anti")).distinct(), "likely2")
    links2 = work.write(_verified(work, texts, more, key, n, percent, "second"), "links2")
    if not links2.isEmpty():
        components = work.write(connected_components(work, links.unionByName(links2), "cc2"), "components2")
    work.drop("placed", "mixed", "ids-mixed", "sets-mixed", "freq", "meets", "parts", "untried", "sketches", "buckets", "leaders", "sigs", "pairs", "likely", "likely2", "links", "links2", "copies", "same-id")
    own = F.coalesce("component", "rep", F.col("id"))
    out = members.join(components, members["rep"] == components["node"], "left").select(
        F.col("id").alias(id_col), "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("id"), F.lit(True)).alias("kept")
    )
    return out


def size_class(sizes: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(sizes, 1)) / math.log(CLASS)).astype(np.int64)


def prefixes(size: int, percent: int) -> list[tuple[int, int, int]]:
    """(own size class, other class, tokens) for a set of ``size`` shingles: where it may reach the similarity with a set of the other class, both share one of their first ``tokens`` shingles in any common order.

    A pair of sizes x, y needs ``c = ceil(percent * (x + y) / (100 + percent))`` common shingles, so the first of them
    stands among the first ``x - c + 1`` of either side; ``c`` is taken for the smallest size that the other may have.
    """
    own = int(size_class(np.array([size]))[0])
    least, most = -(-percent * size // 100), size * 100 // percent
    first, last = (int(k) for k in size_class(np.array([least, most])))
    out = []
    for k in range(first, last + 1):
        other = max(least, math.ceil(CLASS**k - 1e-6))
        tokens = size + (-percent * (size + other) // (100 + percent)) + 1
        if tokens > 0:
            out.append((own, k, tokens))
    return out


def _untried(work: Workspace, buckets: DataFrame, components: DataFrame, texts: DataFrame, key: T.StructField, n: int, percent: int) -> DataFrame:
    """Pairs (x, y) of different components, of texts that share a bucket with another component, that agree in a rare prefix and in size.

    The shingles of these texts are put in one order, rarest first.  A pair that reaches the similarity shares one of the
    first few shingles of this order (``prefixes``), so texts meet at such a shingle only (where more than ``LIGHT`` texts
    hold it: at such a shingle and a pair of size classes); shingles whose holders all lie in one component bring nobody
    together.  Pages of one template share its frequent shingles alone and
    do not meet at all.  A group that is still large is dealt into cells of bounded size.
    """
    placed = work.write(buckets.join(components, buckets["id"] == components["node"], "left").select("key", "id", F.coalesce("component", "id").alias("c")), "placed")
    mixed = work.write(placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key"), "mixed")
    ids = work.write(placed.join(hinted(mixed), "key", "left_semi").select("id", "c").distinct(), "ids-mixed")

    def to_sets(batch: pa.RecordBatch):
        for s, e, text in _words.batch_words(batch, "text", _words.NONSPACE):
            yield {"id": batch.column(0).slice(s, e - s), "c": batch.column(2).slice(s, e - s), "shingles": pa.array([x.view(np.int64) for x in shingle_sets(text, n)], pa.list_(pa.int64()))}

    fields = [key, T.StructField("c", key.dataType, True), longs("shingles")]
    sets = work.write(map_batches(texts.join(hinted(ids), "id").select("id", "text", "c"), fields, to_sets), "sets-mixed")
    held = sets.select("id", "c", F.explode("shingles").alias("shingle"))
    freq = held.groupBy("shingle").agg(F.count("*").alias("df"), F.min("c").alias("low"), F.max("c").alias("high")).where("df > 1")
    freq = work.write(freq.select("shingle", "df", (F.col("low") < F.col("high")).alias("apart")), "freq")
    # at most HOT shingles have more than one in HOT of all places, so the hot ones can be sent everywhere
    line = (freq.agg(F.sum("df")).first()[0] or 0) // HOT
    hot, cold = F.broadcast(freq.where(F.col("df") > line)), freq.where(F.col("df") <= line)
    some = held.select("id", "c", "shingle")
    known = some.join(hot, "shingle").unionByName(some.join(hot, "shingle", "left_anti").join(cold, "shingle", "left").fillna({"df": 1, "apart": False}))
    ranked = known.groupBy("id", "c").agg(F.array_sort(F.collect_list(F.struct("df", "shingle", "apart"))).alias("order"))
    # only what stands among the first shingles and may bring components together goes on to Python
    placed_at = F.transform("order", lambda x, i: F.struct(i.alias("at"), x["shingle"].alias("shingle"), (x["df"] <= LIGHT).alias("light"), x["apart"].alias("apart")))
    longest = F.size("order") - F.ceil(F.size("order") * F.lit(percent) / 100)
    some = F.filter(placed_at, lambda x: x["apart"] & (x["at"] <= longest))
    ranked = ranked.select("id", "c", F.size("order").alias("size"), F.transform(some, lambda x: F.struct(x["at"].alias("at"), x["shingle"].alias("shingle"), x["light"].alias("light"))).alias("some"))

    def to_keys(batch: pa.RecordBatch):
        some, sizes = batch.column(3), batch.column(2).to_pylist()
        cuts = np.asarray(some.offsets)
        values = some.values.slice(cuts[0], cuts[-1] - cuts[0])
        shingles, places, light = values.field("shingle").to_numpy().view(np.uint64), values.field("at").to_numpy().astype(np.int64), values.field("light").to_numpy(zero_copy_only=False)
        cuts = (cuts - cuts[0]).tolist()
        rows, many = [], 0

        def made() -> dict[str, pa.Array]:
            cols = np.concatenate(rows, 1) if rows else np.zeros((6, 0), np.int64)
            rows.clear()
            who = pa.array(cols[0])
            return {"id": batch.column(0).take(who), "c": batch.column(1).take(who), "meet": cols[1], "left": cols[3] - cols[2], "size": cols[3], "own": cols[4], "other": cols[5]}

        for i, (s, e, size) in enumerate(zip(cuts[:-1], cuts[1:], sizes, strict=True)):
            at, key, easy = places[s:e], shingles[s:e], light[s:e]
            picked = [(at[easy], -1, -1, key[easy])]
            heavy, heavy_key = at[~easy], key[~easy]
            for own, other, tokens in prefixes(size, percent) if len(heavy) else ():
                n_use = int(np.searchsorted(heavy, tokens))
                pair = np.uint64(min(own, other) << 32 | max(own, other))
                picked.append((heavy[:n_use], own, other, heavy_key[:n_use] ^ _words.mix(np.array([pair + np.uint64(1)]))))
            for use, own, other, meet in picked:
                if len(use):
                    rows.append(np.stack([np.full(len(use), i), _words.mix(meet).view(np.int64), use, np.full(len(use), size), np.full(len(use), own), np.full(len(use), other)]))
                    many += len(use)
            if many >= 50_000:
                yield made()
                many = 0
        yield made()

    fields = [key, T.StructField("c", key.dataType, True), *(long(x) for x in ("meet", "left", "size", "own", "other"))]
    meets = work.write(map_batches(ranked, fields, to_keys), "meets")
    cells = _cells(work, meets)
    a, b = (cells.select("meet", "r", "o", *(F.col(x).alias(f"{x}_{side}") for x in ("id", "c", "left", "size", "own", "other"))) for side in "ab")
    enough = F.least("left_a", "left_b") * (100 + percent) >= percent * (F.col("size_a") + F.col("size_b"))
    fits = (F.col("id_a") < F.col("id_b")) & (F.col("c_a") != F.col("c_b")) & (F.col("own_a") == F.col("other_b")) & (F.col("other_a") == F.col("own_b")) & enough
    found = a.join(b, ["meet", "r", "o"]).where(fits).select(F.col("id_a").alias("x"), F.col("id_b").alias("y")).distinct()
    return work.write(found, "untried")


def _cells(work: Workspace, meets: DataFrame) -> DataFrame:
    """Rows of the groups (``meet``) that hold several components, dealt into cells (r, o): those outside the group's main component meet all others."""
    counts = meets.groupBy("meet", "c").agg(F.count("*").alias("members"), F.min("own").alias("low"), F.max("own").alias("high"), F.min("other").alias("other"))
    parts = counts.groupBy("meet").agg(
        F.count("*").alias("parts"), F.sum("members").alias("size"), F.max("members").alias("most"), F.max_by("c", F.struct("members", "c")).alias("main"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("other").alias("other"),
    )
    both_sizes = (F.col("low") < F.col("high")) | (F.col("low") == F.col("other"))
    parts = parts.where((F.col("parts") > 1) & both_sizes).select("meet", "main", F.ceil(F.col("most") / BLOCK).cast("int").alias("n_main"), F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int").alias("n_rest"))
    rows = meets.join(hinted(work.write(parts, "parts")), "meet").withColumn("inside", F.col("c") == F.col("main"))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.when(F.col("inside"), F.col("n_main")).otherwise(F.col("n_rest"))).cast("int"))
    # a cell is a pair of blocks: (rest block, main block) or (rest block, later or same rest block, as negative numbers)
    rest = F.col("n_rest") - 1
    cells = F.when(F.col("inside"), F.transform(F.sequence(F.lit(0), rest), lambda r: F.struct(r.alias("r"), F.col("b").alias("o")))).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("n_main") - 1), lambda m: F.struct(F.col("b").alias("r"), m.alias("o"))),
            F.transform(F.sequence(F.lit(0), rest), lambda r: F.struct(F.least(r, F.col("b")).alias("r"), (-1 - F.greatest(r, F.col("b"))).alias("o"))),
        )
    )
    return rows.select("meet", "id", "c", "left", "size", "own", "other", F.explode(F.array_distinct(cells)).alias("cell")).select("meet", F.col("cell.r").alias("r"), F.col("cell.o").alias("o"), "id", "c", "left", "size", "own", "other")


def _verified(work: Workspace, texts: DataFrame, pairs: DataFrame, key: T.StructField, n: int, percent: int, name: str) -> DataFrame:
    """Links (u, v): the pairs whose full shingle sets reach the similarity."""
    ids = work.write(pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))).distinct(), f"ids-{name}")
    needed = texts.join(hinted(ids), "id", "left_semi")

    def to_sets(batch: pa.RecordBatch):
        for s, e, text in _words.batch_words(batch, "text", _words.NONSPACE):
            yield {"id": batch.column(0).slice(s, e - s), "shingles": pa.array([x.tobytes() for x in shingle_sets(text, n)], pa.binary())}

    sets = work.write(map_batches(needed, [key, binary("shingles")], to_sets), f"sets-{name}")
    joined = (
        pairs.join(sets.select(F.col("id").alias("x"), F.col("shingles").alias("sx")), "x")
        .join(sets.select(F.col("id").alias("y"), F.col("shingles").alias("sy")), "y").select("x", "y", "sx", "sy")
    )

    def check(batch: pa.RecordBatch):
        linked = []
        for p, q in zip(batch.column(2), batch.column(3), strict=True):
            u, v = (np.frombuffer(z.as_buffer(), np.uint64) for z in (p, q))
            both = np.sort(np.concatenate([u, v]), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            linked.append(len(both) > 0 and 100 * common >= percent * (len(both) - common))
        mask = pa.array(linked, pa.bool_())
        yield {"u": batch.column(0).filter(mask), "v": batch.column(1).filter(mask)}

    return map_batches(joined, [T.StructField("u", key.dataType, True), T.StructField("v", key.dataType, True)], check)




def keep(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: of each group the row with the smallest id stays.

    Rows without id stay.  Where rows share an id, each row is a document of its own: of those of one group one stays,
    rows of one id with different texts that link with nothing all stay.
    """
    work = Workspace(docs.sparkSession, "neardup-keep")
    found = work.write(near_duplicates(docs, n=n, percent=percent, id_col=id_col, text_col=text_col).select(id_col, "kept"), "found")
    if found.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty():
        gone = work.write(found.where(~F.col("kept")).select(id_col), "gone")
        return docs.join(hinted(gone), id_col, "left_anti").select(docs.columns)
    place = F.lpad((F.col(id_col).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0") if isinstance(docs.schema[id_col].dataType, T.IntegralType) else F.col(id_col).cast("string")
    row = fresh(docs, "_row")
    keyed = work.write(docs.withColumn(row, F.concat(place, F.lit(":"), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))), "rows")
    gone = work.write(near_duplicates(keyed, n=n, percent=percent, id_col=row, text_col=text_col).where(~F.col("kept")).select(row), "gone")
    return keyed.join(hinted(gone), row, "left_anti").select(docs.columns)
