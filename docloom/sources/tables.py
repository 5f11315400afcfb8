"""Parquet tables, and the library's entities over them: documents, chunks, embeddings, feedback, searches, users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Document states in order.
STATES = ("not processed", "extracted", "chunked", "processed")
FEEDBACK = {"purchase": "positive", "error": "negative", "view": "neutral", "click": "click", "signup": "skip"}
SEARCHES = {"purchase": "hybrid", "error": "text", "view": "vector", "click": "hybrid", "signup": "text"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, filename, content, mime_type, file_size, user_id, status, created_at."""
    d, state = table(spark, sf_dir, "documents"), F.array(*map(F.lit, STATES))
    return d.select(
        F.col("doc_id").alias("id"), F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("filename"),
        F.col("text").alias("content"), F.col("lang").alias("mime_type"), F.col("n_chars").alias("file_size"), (F.col("doc_id") % 150).alias("user_id"),
        state[(F.col("doc_id") % 4).cast("int")].alias("status"), F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 60 as int))").alias("created_at"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feedback_id, query_id, feedback_type, user_id, timestamp: the events as judgements of queries."""
    kind = F.create_map(*[F.lit(x) for kv in FEEDBACK.items() for x in kv])
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("feedback_id"), F.get_json_object("props", "$.k").cast("long").alias("query_id"), kind[F.col("event_type")].alias("feedback_type"), "user_id", F.col("ts").cast("timestamp").alias("timestamp")
    )


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search_id, query_id, search_type, response_time_ms, result_count, user_id, created_at: the events as searches."""
    kind = F.create_map(*[F.lit(x) for kv in SEARCHES.items() for x in kv])
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("search_id"), F.get_json_object("props", "$.k").cast("long").alias("query_id"), kind[F.col("event_type")].alias("search_type"),
        F.col("value").alias("response_time_ms"), (F.col("event_id") % 7).alias("result_count"), "user_id", F.col("ts").cast("timestamp").alias("created_at"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, document_id, embedding (doubles): each label is a document of chunks."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("long").alias("document_id"), F.col("embedding").cast("array<double>").alias("embedding"))
