"""Whitening of embeddings through a one-sided Jacobi singular value decomposition (operator 11).

One scan compresses the vectors: every task takes blocks of rows, subtracts the block's mean, and folds the centred rows
into a triangle ``R`` by QR (blockwise TSQR).  Two centred triangles join by the QR of both and of one row more, the
difference of their means times ``sqrt(na * nb / (na + nb))``; so the last ``R`` has ``R'R`` = the sum of centred squares
of all rows, without a second scan and without ever multiplying uncentred rows.  Sums stay exact integers on the way.
Triangles meet in groups of ``FAN`` by rounds of tasks; the driver receives one triangle, whose size is that of a vector
squared, whatever the number of rows.

Plane rotations then make the columns of ``R`` orthogonal.  Their lengths are the singular values, small ones as
accurate as large ones (nothing was squared into a covariance), and the accumulated rotations are the components.

A second scan projects the rows; a scan of the projections measures how near their covariance is to the identity.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm._spark import Workspace, binary, field, long
from docloom.llm.topk import scaled_integers

#: Rows of one QR, and states that one task joins.
BLOCK, FAN = 4096, 16
#: Largest whole number of a vector: sums of a block, and differences from a mean, are exact in 64 bits.
LARGEST = 1 << 50


def joined(a: tuple, b: tuple) -> tuple:
    """The state (rows, exact sums, triangle) of two sets of rows together."""
    (na, sa, ra), (nb, sb, rb) = a, b
    if len(sa) != len(sb):
        raise ValueError("vectors differ in length")
    gap = np.array([(nb * x - na * y) / (na * nb) for x, y in zip(sa, sb, strict=True)])  # whole numbers up to the division
    return na + nb, [x + y for x, y in zip(sa, sb, strict=True)], np.linalg.qr(np.vstack([ra, rb, gap * math.sqrt(na / (na + nb) * nb)]), mode="r")


def block_state(rows: np.ndarray) -> tuple:
    """The state of a block of rows of 64-bit integers."""
    n, sums = len(rows), rows.sum(0)
    centred = (rows - sums // n).astype(np.float64) - (sums % n) / n  # the whole part goes exactly
    return n, sums.tolist(), np.linalg.qr(centred, mode="r")


def moments(rows: np.ndarray) -> tuple:
    """(rows, means, centred products) of a block of rows of doubles."""
    mean = rows.mean(0)
    return len(rows), mean, (rows - mean).T @ (rows - mean)


def joined_moments(a: tuple, b: tuple) -> tuple:
    (na, ma, pa_), (nb, mb, pb) = a, b
    gap, n = mb - ma, na + nb
    return n, ma + gap * (nb / n), pa_ + pb + np.outer(gap, gap) * (na / n * nb)


def fold(work: Workspace, df: DataFrame, blocks: Callable[[pa.RecordBatch], Iterator[tuple]], join: Callable[[tuple, tuple], tuple], name: str) -> tuple | None:
    """All rows of ``df`` as one state: a state a task, then groups of ``FAN`` states by rounds of tasks; None without rows."""
    schema = T.StructType([long("at"), binary("state")])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = None
        for batch in batches:
            for more in blocks(batch):
                state = more if state is None else join(state, more)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())], names=["at", "state"])

    def group(table: pa.Table) -> pa.Table:
        state = None
        for _, x in sorted(zip(table.column("at").to_pylist(), table.column("state").to_pylist(), strict=True)):
            state = pickle.loads(x) if state is None else join(state, pickle.loads(x))
        return pa.table({"at": table.column("at").slice(0, 1), "state": pa.array([pickle.dumps(state)], pa.binary())})

    step, states = 0, work.write(df.mapInArrow(each, schema), f"{name}-0")
    while (many := states.count()) > 1:
        step += 1
        groups = -(-many // FAN)
        states = work.write(states.groupBy(F.pmod(F.xxhash64("at"), F.lit(groups)).alias("group")).applyInArrow(group, schema), f"{name}-{step}")
        work.drop(f"{name}-{step - 1}")
    first = states.first()
    work.drop(f"{name}-{step}")
    return None if first is None else pickle.loads(first["state"])


def jacobi(triangle: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of a matrix, falling, and its right singular vectors as columns, by plane rotations of its columns.

    A sweep meets every pair of columns once, in rounds of disjoint pairs that turn at the same time.  It is done when a
    sweep finds every pair orthogonal to rounding.
    """
    d = triangle.shape[1]
    a = np.zeros((triangle.shape[0], d + d % 2))
    a[:, :d] = triangle
    v = np.eye(d + d % 2)
    tolerance = np.finfo(float).eps * math.sqrt(d)
    ring = np.arange(d + d % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            p, q = ring[: len(ring) // 2], ring[::-1][: len(ring) // 2]
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(gamma) > tolerance * np.sqrt(alpha) * np.sqrt(beta)
            if turn.any():
                turned = True
                p, q, alpha, beta, gamma = p[turn], q[turn], alpha[turn], beta[turn], gamma[turn]
                zeta = (beta - alpha) / (2 * gamma)
                t = np.copysign(1, zeta) / (np.abs(zeta) + np.hypot(1, zeta))
                c = 1 / np.hypot(1, t)
                for m in (a, v):
                    x, y = m[:, p], m[:, q]
                    m[:, p], m[:, q] = c * x - c * t * y, c * t * x + c * y
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not turned:
            break
    else:
        raise ArithmeticError("the rotations did not settle")
    sizes = np.linalg.norm(a, axis=0)[:d]
    order = np.argsort(-sizes, kind="stable")
    v = v[:d, :d][:, order]
    return sizes[order], v / np.linalg.norm(v, axis=0)


def whiten(vectors: DataFrame, k: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable row of ``vectors`` and component: id, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Entries become the whole numbers ``x = floor(scale * c) + shift``; ``n`` vectors have the sums ``S``.  ``deviation``
    is the sum of ``(n * x - S)^2`` over the dimensions, exact (decimal); ``whitened`` is ``x - S/n`` projected on the
    unit component over the component's standard deviation; ``explained`` its share of all variance; ``identity_error``
    the largest entry of the measured covariance of ``whitened`` minus the identity.

    Rows whose vector is null, empty or holds null or non-finite entries take no part.  Null ids and repeated rows count
    like any other row.  Components of equal variance come in any rotation, the same for all rows.  Components without
    variance (all vectors equal, fewer vectors or dimensions than ``k``, dimensions that depend on others) have no whitened
    form and are not listed.  Vectors of different length, and entries beyond 2^50 after scaling, are an error.  An
    empty table gives an empty result; other columns are not read.
    """
    work = Workspace(vectors.sparkSession, "whitening")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))

    def integers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        keep, x = scaled_integers(batch.column(1), scale)
        if x.size and max(-int(x.min()), int(x.max())) > LARGEST:
            raise ValueError("an entry is out of range")
        return keep, x + shift

    def blocks(batch: pa.RecordBatch) -> Iterator[tuple]:
        _, x = integers(batch)
        for k0 in range(0, len(x), BLOCK):
            yield block_state(x[k0 : k0 + BLOCK])

    found = fold(work, rows, blocks, joined, "triangles")
    schema = T.StructType([field(rows, "id"), T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    if found is None:
        n, sums, sizes, turned = 0, [], np.zeros(0), np.zeros((0, 0))
    else:
        n, sums, triangle = found
        sizes, turned = jacobi(triangle)
    usable = int((sizes > sizes[0] * np.finfo(float).eps * max(8, len(sizes))).sum()) if len(sizes) and sizes[0] > 0 else 0
    k = min(k, usable)
    to_unit = turned[:, :k] / (sizes[:k] / math.sqrt(max(n, 1)))
    explained = (sizes[:k] ** 2 / (sizes**2).sum()).tolist() if k else []

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, over = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], object)
        for batch in batches:
            keep, x = integers(batch)
            if len(keep):
                x = x - whole  # n * x - S is n times this, less what the division left over
                if int(np.abs(x).max()) + 1 < math.isqrt((1 << 62) // x.shape[1]) // n:
                    gap = n * x - over.astype(np.int64)
                    far = pa.array((gap * gap).sum(1), pa.int64()).cast(pa.decimal128(38, 0))
                else:
                    from decimal import Decimal

                    gap = x.astype(object) * n - over
                    far = pa.array([Decimal(int(g)) for g in (gap * gap).sum(1)], pa.decimal128(38, 0))
                out = (gap / n).astype(np.float64) @ to_unit
                lists = pa.ListArray.from_arrays(np.arange(0, out.size + 1, k, dtype=np.int32), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), far, lists], names=["id", "deviation", "whitened"])

    if not k:
        rows = rows.limit(0)
    scored = work.write(rows.mapInArrow(project, schema), "scored")

    def measured(batch: pa.RecordBatch) -> Iterator[tuple]:
        if batch.num_rows:
            yield moments(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))

    spread = fold(work, scored.select("whitened"), measured, joined_moments, "moments") if k else None
    error = float(np.abs(spread[2] / spread[0] - np.eye(k)).max()) if spread else 0.0
    return scored.select(F.col("id").alias(id_col), "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        _at(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def _at(values: list[float], place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values or [0.0])), place + 1)
