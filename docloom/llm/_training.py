"""A bounded, deterministic sample of labelled documents for the classifiers, and the learn/held-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents with this remainder of crc32(id as text) modulo ``FOLDS`` are never learnt from.
FOLDS, HELD_OUT = 5, 0


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of learning (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y): at most ``max_rows`` labelled documents outside the held-out fold, in the labels' own mix.

    The rows with the smallest hash of their id are taken whatever their label, so the sample does not depend on
    partitions, its size does not grow with the tables, and the prior that a model learns from it is that of all
    labels at every size; rows with null id or label take no part, of an id labelled twice the largest label counts.
    """
    known = (
        labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("_id")))
        .groupBy("_id").agg(F.max("y").alias("y"))
    )
    chosen = F.broadcast(known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows))  # at most max_rows ids
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(chosen, "_id").select("_id", "text", "y")
