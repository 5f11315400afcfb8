"""Connected components of an edge table by alternating star contractions, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._spark import Workspace


def connected_components(work: Workspace, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v); the component is its smallest node.

    Large stars hang each node's larger neighbours on its smallest neighbour, small stars its smaller ones; the edge
    set never grows and becomes one star per component after O(log^2) rounds.  Each round is a written table.
    """
    now = work.write(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), f"{name}-0"
    )
    state, step = _state(now), 0
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = work.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-{step}-large")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = work.write(large, f"{name}-{step}-hung")
        least2 = work.write(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{step}-small")
        moved = large.join(least2, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(least2.select("u", F.col("m").alias("v"))).distinct()
        step += 1
        after = work.write(small, f"{name}-{step}")
        work.drop(f"{name}-{step - 1}", f"{name}-{step - 1}-large", f"{name}-{step - 1}-hung", f"{name}-{step - 1}-small")
        before, state = state, _state(after)
        now = after
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Count and order-free digest of an edge table."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
