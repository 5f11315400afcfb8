"""Exact top-k search by inner product with a KD-tree per shard (operator 1).

Vectors are turned into integers and dealt into cells, the lower ends of the upper levels of one KD-tree (median splits
of a bounded sample), and cells into shards of bounded size by a hash of their ids.  Each shard becomes a KD-tree:
median splits along the widest dimension, with the tight bounding box of every node.  A box bounds the inner product of
a query from above (per dimension the better of its two sides).  A search visits nodes best bound first and stops when
the best bound left is below the k-th score so far.  That k-th score is propagated: every query first searches one
shard of the cell that it would itself lie in; its k-th score there rules out whole cells by their boxes (a small
table, at most ``SAMPLE / LEAST`` rows) before the query is sent anywhere, and prunes the trees of the rest from the start.

Queries meet shards in bounded chunks: each (shard, chunk) pair is one task group of one tree and at most about ``CHUNK``
queries.  Trees and seeds are written tables.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm._spark import Workspace, binary, integer, long, map_batches

SHARD_ROWS, LEAF_ROWS, CHUNK = 8192, 128, 4096
#: Rows of the sample that the upper levels are split on (those with the smallest hash of their id), and the fewest of a cell.
SAMPLE, LEAST = 20_000, 16


class Cells:
    """Upper levels of one KD-tree; every vector falls into one of ``count`` cells."""

    def __init__(self, sample: np.ndarray, parts: int) -> None:
        dims, cuts, left, right = [], [], [], []
        self.count = 0

        def grow(rows: np.ndarray, parts: int) -> int:
            node = len(dims)
            for x in (dims, cuts, left, right):
                x.append(0)
            wide = rows.std(0) if len(rows) else np.zeros(1)
            if parts < 2 or len(rows) < 2 * LEAST or not wide.any():
                dims[node], left[node] = -1, self.count
                self.count += 1
                return node
            along = rows[:, int(wide.argmax())]
            cut = np.partition(along, len(along) // 2)[len(along) // 2]
            if cut == along.min():
                cut = along[along > cut].min()
            dims[node], cuts[node] = int(wide.argmax()), cut
            left[node], right[node] = grow(rows[along < cut], parts // 2), grow(rows[along >= cut], parts - parts // 2)
            return node

        grow(sample, parts)
        self.dims, self.cuts, self.left, self.right = (np.array(x, np.int64) for x in (dims, cuts, left, right))

    def of(self, rows: np.ndarray) -> np.ndarray:
        node, each = np.zeros(len(rows), np.int64), np.arange(len(rows))
        while (inner := self.dims[node] >= 0).any():
            below = rows[each, np.maximum(self.dims[node], 0)] < self.cuts[node]
            node = np.where(inner, np.where(below, self.left[node], self.right[node]), node)
        return self.left[node]


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a column of equally long binaries of 64-bit integers."""
    parts = column.to_pylist()
    if len({len(x) for x in parts}) > 1:
        raise ValueError("vectors differ in length")
    return np.frombuffer(b"".join(parts), "<i8").reshape(len(parts), -1)


def box_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(query, box) bounds of the inner product from above, with room for rounding."""
    q = queries.astype(np.float64)
    bounds = np.maximum(q, 0) @ high.T.astype(np.float64) + np.minimum(q, 0) @ low.T.astype(np.float64)
    return bounds + np.abs(bounds) * 1e-9 + 1e3


class Tree:
    """A KD-tree over integer rows: boxes, children (-1 at leaves) and each node's run of rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF_ROWS) -> None:
        order = np.arange(len(ids))
        low, high, left, right, runs = [], [], [], [], []

        def grow(a: int, b: int) -> int:
            own = rows[order[a:b]]
            node = len(low)
            low.append(own.min(0)), high.append(own.max(0)), left.append(-1), right.append(-1), runs.append((a, b))
            spread = high[node] - low[node]
            if b - a > leaf and spread.max() > 0:
                mid = (a + b) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, int(spread.argmax())], mid - a)]
                left[node], right[node] = grow(a, mid), grow(mid, b)
            return node

        grow(0, len(ids))
        self.low, self.high = np.array(low), np.array(high)
        self.left, self.right, self.runs = left, right, runs
        self.ids, self.rows = ids[order], rows[order]
        self.largest = int(np.abs(rows).max(initial=0))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: list[int | None]) -> list[list[tuple[int, int]]]:
        """Per query the k best (score, id), best first, ties to the smaller id, among rows of other ids that are not below ``floor``."""
        exact = self.largest * int(np.abs(queries).max(initial=0)) * queries.shape[1] < 1 << 52
        q = queries.astype(np.float64)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        bounds = up @ self.high.T.astype(np.float64) + down @ self.low.T.astype(np.float64)
        if not exact:  # room for rounding; scores themselves are 64-bit integers
            bounds += np.abs(bounds) * 1e-9 + 1e3
        rows = self.rows.astype(np.float64) if exact else self.rows
        out = []
        for i, own in enumerate(query_ids.tolist()):
            bound, x = bounds[i], (q[i] if exact else queries[i])
            least = -math.inf if floor[i] is None else floor[i]
            best: list[tuple[int, int]] = []  # a heap of (score, -id): its first is the k-th
            todo = [(-bound[0], 0)]
            while todo and -todo[0][0] >= least:
                node = heapq.heappop(todo)[1]
                if self.left[node] >= 0:
                    for child in (self.left[node], self.right[node]):
                        if bound[child] >= least:
                            heapq.heappush(todo, (-bound[child], child))
                    continue
                a, b = self.runs[node]
                scores = rows[a:b] @ x
                for j in np.flatnonzero(scores >= least).tolist():
                    if (other := int(self.ids[a + j])) != own:
                        item = (int(scores[j]), -other)
                        if len(best) < k:
                            heapq.heappush(best, item)
                        elif item > best[0]:
                            heapq.heapreplace(best, item)
                if len(best) == k:
                    least = max(least, best[0][0])
            out.append([(s, -n) for s, n in sorted(best, reverse=True)])
        return out


def scaled_integers(vectors: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable rows of an array of lists (not null, not empty, every entry finite) and their matrix of floor(scale * x).

    Usable rows of different length, and entries that do not fit 64 bits, are an error.
    """
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy().astype(np.int64)
    x = np.floor(vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * scale)  # null entries become NaN
    ends = np.cumsum(sizes)
    finite = np.isfinite(vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
    bad = np.concatenate([[0], np.cumsum(~finite)])
    keep = np.flatnonzero((sizes > 0) & (bad[ends] == bad[ends - sizes]))
    if len(keep) and sizes[keep].min() != sizes[keep].max():
        raise ValueError("vectors differ in length")
    rows = x[np.repeat(np.isin(np.arange(len(sizes)), keep), sizes)].reshape(len(keep), sizes[keep[0]] if len(keep) else 0)
    if rows.size and np.abs(rows).max() >= 2.0**63:
        raise ValueError("a component is out of range")
    return keep, rows.astype(np.int64)


def _integers(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, pa.Array]:
    """Indices of usable rows of a batch (id, vector), ids not null, and their vectors as little-endian 64-bit integers."""
    keep, rows = scaled_integers(batch.column(1), scale)
    known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)[keep]
    return keep[known], pa.array([x.tobytes() for x in rows[known].astype("<i8")], pa.binary())


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE, chunk: int = CHUNK,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """For each row of ``queries`` its ``k`` best rows of ``vectors`` by integer inner product: query_id, rank (from 1), vec_id, score.

    Components become ``floor(scale * x)``.  A row of the query's own id is no candidate; ties go to the smaller id;
    with fewer candidates all are returned.  Rows with null id, or whose vector is null, empty or holds null or
    non-finite components, take no part.  Rows that share an id count once (the largest vector, by its bytes).  All
    vectors must have one length and components must fit 64 bits once scaled (else an error); scores must fit 64 bits.  An empty table on either side gives an empty
    result; other columns are not read.  The sample (``sample_rows``) only says where cells are cut, never which rows count.
    """
    work = Workspace(vectors.sparkSession, "topk")

    def whole(df: DataFrame, name: str) -> DataFrame:
        def each(batch: pa.RecordBatch):
            keep, rows = _integers(batch, scale)
            yield {"id": batch.column(0).take(pa.array(keep)).cast(pa.int64()), "v": rows}

        made = map_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")), [long("id"), binary("v")], each)
        return work.write(made.groupBy("id").agg(F.max("v").alias("v")), name)

    rows, asked = whole(vectors, "rows"), whole(queries, "queries")
    parts = math.ceil(rows.count() / shard_rows)
    n_chunks = max(1, math.ceil(asked.count() / chunk))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toArrow() if parts > 1 else None  # at most sample_rows
    cells = Cells(matrix(drawn.column("v").combine_chunks()) if drawn else np.zeros((0, 1), np.int64), parts)

    def with_cell(batch: pa.RecordBatch):
        yield {"id": batch.column(0), "v": batch.column(1), "cell": cells.of(matrix(batch.column(1)))}

    placed = work.write(map_batches(rows.select("id", "v"), [long("id"), binary("v"), long("cell")], with_cell), "placed")
    # a cell of any size (many equal vectors, too) is dealt into shards by hash
    sizes = sorted((r["cell"], -(-r["count"] // shard_rows)) for r in placed.groupBy("cell").count().collect())  # at most SAMPLE / LEAST cells
    many = dict(sizes)
    first = dict(zip([c for c, _ in sizes], np.concatenate([[0], np.cumsum([m for _, m in sizes])]).tolist(), strict=False))

    def look(table: dict[int, int], cell: Column) -> Column:
        return F.element_at(F.lit([table.get(c, 0) for c in range(cells.count)]), (cell + 1).cast("int"))

    def shard_of(cell: Column, seed: int) -> Column:
        return (look(first, cell) + F.pmod(F.xxhash64("id", F.lit(seed)), look(many, cell))).cast("int")

    def build(table: pa.Table) -> pa.Table:
        order = np.argsort(ids := table.column("id").to_numpy())
        tree = Tree(ids[order], matrix(table.column("v").combine_chunks())[order])
        box = [pa.array([x[0].astype("<i8").tobytes()], pa.binary()) for x in (tree.low, tree.high)]
        return pa.table({"shard": table.column("shard").slice(0, 1), "cell": table.column("cell").slice(0, 1), "low": box[0], "high": box[1], "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    shards = T.StructType([integer("shard"), long("cell"), binary("low"), binary("high"), binary("tree")])
    trees = work.write(placed.withColumn("shard", shard_of(F.col("cell"), 1)).groupBy("shard").applyInArrow(build, shards), "trees")
    work.drop("placed")

    def merge(table: pa.Table) -> pa.Table:
        low, high = matrix(table.column("low").combine_chunks()).min(0), matrix(table.column("high").combine_chunks()).max(0)
        return pa.table({"cell": table.column("cell").slice(0, 1), "low": pa.array([low.tobytes()], pa.binary()), "high": pa.array([high.tobytes()], pa.binary())})

    boxes = trees.select("cell", "low", "high").groupBy("cell").applyInArrow(merge, T.StructType([long("cell"), binary("low"), binary("high")])).orderBy("cell").toArrow()  # one row a cell
    box_cells = boxes.column("cell").to_numpy()
    if not len(box_cells):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    low, high = (matrix(boxes.column(c).combine_chunks()) for c in ("low", "high"))

    hits = T.StructType([long("query_id"), long("vec_id"), long("score"), integer("rank")])

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        if left.num_rows and right.num_rows:
            tree = pickle.loads(left.column("tree")[0].as_py())
            ids = right.column("id").to_numpy()
            found = tree.search(ids, matrix(right.column("v").combine_chunks()), k, right.column("floor").to_pylist())
            out = [(q, n, s, r + 1) for q, best in zip(ids.tolist(), found, strict=True) for r, (s, n) in enumerate(best)]
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.table({f.name: pa.array(c, pa.int32() if f.name == "rank" else pa.int64()) for f, c in zip(hits, cols, strict=True)})

    def search(tasks: DataFrame, name: str) -> DataFrame:
        """``tasks`` (shard, id, v, floor): each query against one tree."""
        dealt = tasks.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_chunks)).cast("int"))
        each = trees.select("shard", "tree", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk"))
        return work.write(each.groupBy("shard", "chunk").cogroup(dealt.groupBy("shard", "chunk")).applyInArrow(probe, hits), name)

    def to_seed(batch: pa.RecordBatch):
        own = cells.of(matrix(batch.column(1)))
        full = np.isin(own, box_cells)  # a cell may be empty
        yield {"id": batch.column(0), "v": batch.column(1), "cell": np.where(full, own, box_cells[0])}

    seeds = map_batches(asked.select("id", "v"), [long("id"), binary("v"), long("cell")], to_seed)
    seeds = work.write(seeds.select("id", "v", shard_of(F.col("cell"), 2).alias("shard"), F.lit(None).cast("long").alias("floor")), "seeded")
    found = search(seeds, "seeds")
    floors = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))

    def to_cells(batch: pa.RecordBatch):
        floor = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)  # null: NaN, which rules out nothing
        query, cell = np.nonzero(~(box_bounds(matrix(batch.column(1)), low, high) < floor[:, None]))
        at = pa.array(query)
        yield {"id": batch.column(0).take(at), "v": batch.column(1).take(at), "seed": batch.column(2).take(at), "floor": batch.column(3).take(at), "cell": box_cells[cell]}

    fields = [long("id"), binary("v"), integer("seed"), long("floor"), long("cell")]
    asked_cells = map_batches(seeds.join(floors, "id", "left").select("id", "v", F.col("shard").alias("seed"), floors["floor"]), fields, to_cells)
    each = F.explode(F.sequence(look(first, F.col("cell")), look(first, F.col("cell")) + look(many, F.col("cell")) - 1)).alias("shard")
    rest = asked_cells.select("id", "v", "floor", "seed", each).where("shard != seed").select(F.col("shard").cast("int").alias("shard"), "id", "v", "floor")
    second = search(rest, "rest")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.drop("rank").unionByName(second.drop("rank")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    work.drop("rows", "queries", "trees", "seeded")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
