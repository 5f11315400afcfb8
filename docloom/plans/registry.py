"""Queries by name, each with the SQL that says the same in DuckDB (None: rows only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


#: The entities of ``sources.tables`` in DuckDB.
DOCS = """(SELECT doc_id AS id, source || '-' || CAST(doc_id AS VARCHAR) || '.md' AS filename, text AS content, lang AS mime_type, n_chars AS file_size,
  doc_id % 150 AS user_id, ['not processed', 'extracted', 'chunked', 'processed'][CAST(doc_id % 4 AS INT) + 1] AS status,
  TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 60 AS INT)) AS created_at FROM documents)"""
FEEDBACK = """(SELECT event_id AS feedback_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS query_id,
  CASE event_type WHEN 'purchase' THEN 'positive' WHEN 'error' THEN 'negative' WHEN 'view' THEN 'neutral' WHEN 'click' THEN 'click' WHEN 'signup' THEN 'skip' END AS feedback_type,
  user_id, ts AS timestamp FROM events)"""
SEARCHES = """(SELECT event_id AS search_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS query_id,
  CASE event_type WHEN 'purchase' THEN 'hybrid' WHEN 'error' THEN 'text' WHEN 'view' THEN 'vector' WHEN 'click' THEN 'hybrid' WHEN 'signup' THEN 'text' END AS search_type,
  value AS response_time_ms, event_id % 7 AS result_count, user_id, ts AS created_at FROM events)"""
VECTORS = "(SELECT vec_id AS chunk_id, CAST(label AS BIGINT) AS document_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"
