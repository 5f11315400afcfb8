"""The corpus pipeline: documents go through quality, toxicity, near-duplicate and benchmark filters and are packed.

Each stage takes what its predecessor kept (read again from Parquet) and returns the columns of ``documents``; the last
returns the packed pieces.  Models are learnt from the labelled documents outside the held-out fold that are still
there.  A row without an id is judged like any other and kept where the judgement lets it pass.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docloom.llm import decontaminate, neardup, packing, quality, toxicity
from docloom.llm._spark import Workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document passes at this quality score or above, and below this toxicity score.
QUALITY, TOXICITY = 0.3, 0.5
#: Stages that SQL cannot express (models, hashes in floating point) make the whole not expressible.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the quality classifier accepts."""
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.keep(docs.select(COLUMNS), model, QUALITY)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the toxicity classifier does not mark."""
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.keep(docs.select(COLUMNS), model, TOXICITY)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, the one with the smallest id."""
    return neardup.keep(docs.select(COLUMNS), n=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that share no window of words with the benchmark."""
    return decontaminate.keep(docs.select(COLUMNS), _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed training sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_filter),
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicate_filter),
    ("decontamination", decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    work = Workspace(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.write(stage(spark, docs, sf_dir), name)
    return docs
