"""Queries of stored tables and stateful streams over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import tablestore
from docloom.plans.registry import SEARCHES, query
from docloom.sources import tables
from docloom.sources.shared import Scratch
from docloom.streaming import limits, stateful


@query(f"SELECT query_id, count(*) AS search_count, min(created_at) AS first_seen, max(created_at) AS last_seen FROM {SEARCHES} WHERE query_id IS NOT NULL GROUP BY query_id")
def query_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of queries kept in a stored table: three batches of searches are merged into it, one of them sent twice."""
    table = tablestore.KeyedTable(spark, Scratch(spark, "counts").path, "query_id bigint, search_count bigint, first_seen timestamp, last_seen timestamp", ["query_id"], 8)
    s = tables.searches(spark, sf)
    for part in (0, 1, 1, 2):
        tablestore.upsert_counts(table, s.where(F.col("search_id") % 3 == part), "query_id", "created_at", "searches", part)
    return table.read()


@query("""WITH d AS (SELECT sha256(text) AS content_hash, length(text) AS n, doc_id FROM documents WHERE text IS NOT NULL), p AS (SELECT DISTINCT 'model a' AS settings, content_hash, n FROM d UNION ALL SELECT DISTINCT 'model b', content_hash, n FROM d WHERE doc_id % 2 = 0)
  SELECT settings, content_hash, CAST(n AS VARCHAR) AS result, CASE WHEN settings = 'model b' OR content_hash IN (SELECT content_hash FROM d WHERE doc_id % 3 = 0) THEN 1 ELSE 2 END AS run FROM p""")
def cached_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results kept by content and settings: a third of the documents, then all of them (only new contents are computed), then half of them under other settings."""
    results = tablestore.KeyedTable(spark, Scratch(spark, "cache").path, tablestore.CACHE, ["content_hash", "settings"], 8)
    docs = tables.table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))

    def measured(run: int):
        return lambda df: df.select("content_hash", F.concat(F.length("content").cast("string"), F.lit(f" {run}")).alias("result"), F.lit(None).cast("string").alias("error"))

    tablestore.run_due(results, docs.where("doc_id % 3 = 0"), "model a", measured(1))
    tablestore.run_due(results, docs, "model a", measured(2))
    tablestore.run_due(results, docs.where("doc_id % 2 = 0"), "model b", measured(1))
    parts = F.split("result", " ")
    return results.read().select("settings", "content_hash", parts[0].alias("result"), parts[1].cast("int").alias("run"))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, sha256(coalesce(text, '')) AS content_hash, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM documents")
def ingested_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that come as a stream of files and are merged, batch by batch, into a stored table."""
    work = Scratch(spark, "ingest")
    files = tables.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    n = max(4, files.rdd.getNumPartitions())  # files grow in number, not in size
    files.repartition(n).write.parquet(work.at("in"))
    table = tablestore.documents(spark, work.at("table"), 8)
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", -(-n // 2)).parquet(work.at("in"))  # two batches
    tablestore.ingest(stream, table, work.at("marks")).awaitTermination()
    return table.read().select("path", "content_hash", "bytes")


_ROLE = "['basic', 'premium', 'admin', 'guest'][CAST(user_id % 4 AS INT) + 1]"
# limits of the query, small enough to be met
_ROLES = {"basic": (2, 3600), "premium": (5, 7200), "admin": (9, 86400)}


@query(f"""WITH e AS (SELECT event_id, ts, event_type, {_ROLE} AS role FROM events), l AS (SELECT *, CASE role WHEN 'premium' THEN 5 WHEN 'admin' THEN 9 ELSE 2 END AS most, CASE role WHEN 'premium' THEN 7200 WHEN 'admin' THEN 86400 ELSE 3600 END AS s FROM e),
  n AS (SELECT *, row_number() OVER (PARTITION BY event_type, role, s, floor(epoch(ts) / s) ORDER BY ts, event_id) AS n FROM l)
  SELECT event_id AS request_id, event_type AS client, role AS kind, n <= most AS accepted, CAST(greatest(most - n, 0) AS INT) AS remaining FROM n""")
def limit_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Every request accepted or rejected by the limit of its role."""
    e = tables.table(spark, sf, "events")
    role = F.array(*map(F.lit, ("basic", "premium", "admin", "guest")))[(F.col("user_id") % 4).cast("int")]
    requests = e.select(F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("client"), role.alias("kind"))
    return stateful.decide(stateful.limited(requests, "kind", limits.LIMITS | _ROLES | {"api": _ROLES["basic"]})).select("request_id", "client", "kind", "accepted", "remaining")


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, ts, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'complete' ELSE 'step' END AS kind, CAST(event_id % 9 AS INT) AS total FROM events),
  r AS (SELECT *, sum(CASE WHEN ts - l > INTERVAL 2 hours THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, kind, total ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(ts) OVER (PARTITION BY session_id ORDER BY ts, kind, total) AS l FROM e))
  SELECT session_id, min(ts) AS start, max(ts) AS last, CAST(count(*) FILTER (kind = 'step') AS INT) AS done, max(total) AS total,
    CASE WHEN max(total) > 0 THEN least(100, 100 * count(*) FILTER (kind = 'step') / max(total)) ELSE 0.0 END AS percent, CASE WHEN bool_or(kind = 'complete') THEN 'completed' ELSE 'expired' END AS status FROM r GROUP BY session_id, run""")
def session_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of every user that pause for two hours or complete."""
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "complete").otherwise("step")
    e = tables.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), (F.col("event_id") % 9).cast("int").alias("total"))
    return stateful.session_ends(e, 7200)


_EVENT = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'extracted' WHEN 'error' THEN 'failed' ELSE CASE WHEN event_id % 2 = 0 THEN 'chunked' ELSE 'completed' END END"
_LEGAL = "(" + " OR ".join(f"coalesce(f.status, '') = '{k or ''}' AND e.event IN ({', '.join(f"'{x}'" for x in v)})" + (f" AND f.retries < {stateful.RETRIES}" if k == "failed" else "") for k, v in stateful.MOVES.items() if v) + ")"
_GAIN = "CASE e.event " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in stateful.PROGRESS.items()) + " ELSE f.progress END"


@query(f"""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS job_id, event_id, ts, {_EVENT} AS event, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
  f AS (SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS event, false AS legal, CAST(NULL AS VARCHAR) AS status, 0 AS progress, 0 AS retries, 0 AS rejected FROM e
    UNION ALL SELECT e.job_id, e.r, e.event_id, e.event, {_LEGAL}, CASE WHEN {_LEGAL} THEN e.event ELSE f.status END, CASE WHEN {_LEGAL} THEN {_GAIN} ELSE f.progress END,
      f.retries + CASE WHEN {_LEGAL} AND f.status = 'failed' THEN 1 ELSE 0 END, f.rejected + CASE WHEN {_LEGAL} THEN 0 ELSE 1 END FROM f JOIN e ON e.job_id = f.job_id AND e.r = f.r + 1)
  SELECT job_id, event_id, event, legal, status, progress, retries, rejected FROM f WHERE r > 0""")
def job_events(spark: SparkSession, sf: str) -> DataFrame:
    """Every event of every user's job, whether it was legal, and the job's state after it."""
    e = tables.table(spark, sf, "events")
    return stateful.job_events(e.select(F.col("user_id").cast("string").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.expr(_EVENT).alias("event"))).drop("ts")
