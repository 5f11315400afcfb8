"""Vector arithmetic on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0 or the lengths differ, null where a vector is null."""
    n = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), None).when((n == 0) | (F.size(a) != F.size(b)), 0.0).otherwise(dot(a, b) / n)


def mean_pool(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, embedding): the mean of each group's vectors, dimension by dimension (partial sums before the shuffle)."""
    each = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias(vector))
