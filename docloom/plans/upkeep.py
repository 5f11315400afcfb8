"""Queries of document upkeep: chunks replaced, versions, collaborators, comments, logs, file checks, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import scores
from docloom.functions import text as t
from docloom.operators import browse, checks, chunking, lifecycle
from docloom.plans.registry import DOCS, VECTORS, query
from docloom.plans.retrieval import FIXED_SQL
from docloom.sources import tables
from docloom.sources.tables import table
from docloom.streaming import limits

_STATUS = "['not processed', 'extracted', 'chunked', 'processed'][CAST(doc_id % 4 AS INT) + 1]"


@query(f"""WITH o AS (SELECT doc_id, chunk_index, chunk_text FROM ({FIXED_SQL})), d AS (SELECT doc_id, {_STATUS} AS status, length(text) > 0 AND doc_id % 4 < 2 AS due FROM documents),
  n AS (SELECT o.doc_id, count(*) AS chunks FROM o JOIN d USING (doc_id) WHERE NOT due GROUP BY 1 UNION ALL SELECT doc_id, CAST(ceil(n / 300.0) AS BIGINT) FROM (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n, due FROM documents JOIN d USING (doc_id)) WHERE due AND n > 0)
  SELECT doc_id, CASE WHEN due THEN 'chunked' ELSE status END AS status, coalesce(chunks, 0) AS chunks FROM d LEFT JOIN n USING (doc_id)""")
def rechunked(spark: SparkSession, sf: str) -> DataFrame:
    d = tables.documents(spark, sf).select(F.col("id").alias("doc_id"), F.col("content").alias("text"), "status")
    old = chunking.fixed(d, 100, 20).select("doc_id", "chunk_index", "chunk_text")
    docs, now = lifecycle.rechunk(d, old, lambda x: chunking.fixed(x, 300, 0))
    return docs.join(now.groupBy("doc_id").agg(F.count("*").alias("chunks")), "doc_id", "left").select("doc_id", "status", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("""WITH v AS (SELECT o_custkey AS document_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version_number, o_orderpriority AS content FROM orders), m AS (SELECT max(version_number) AS n FROM v WHERE document_id = 7)
  SELECT document_id, version_number, content FROM v UNION ALL SELECT 7, n + 1, 'current' FROM m UNION ALL SELECT 7, n + 2, content FROM v, m WHERE document_id = 7 AND version_number = 2""")
def version_restore(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), "o_orderkey", F.col("o_orderpriority").alias("content"))
    v = lifecycle.number_versions(o, "document_id", ["o_orderkey"]).select("document_id", F.col("version_number").cast("long").alias("version_number"), "content")
    current = table(spark, sf, "customer").select(F.col("c_custkey").alias("document_id"), F.lit("current").alias("content"))
    return lifecycle.restore_version(v, current, 7, 2).withColumn("version_number", F.col("version_number").cast("long"))


@query("""WITH c AS (SELECT DISTINCT o_custkey % 50 AS document_id, o_custkey AS user_id FROM orders WHERE o_orderkey % 3 = 0), n AS (SELECT DISTINCT o_custkey % 50 AS document_id, o_custkey AS user_id FROM orders WHERE o_orderkey % 2 = 0)
  SELECT document_id, user_id, level AS permission_level, NOT (document_id = 1 AND user_id = 1) AS is_active FROM (SELECT *, 'viewer' AS level FROM c UNION ALL SELECT *, 'editor' FROM n ANTI JOIN c USING (document_id, user_id))""")
def collaborators_changed(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("document_id"), F.col("o_custkey").alias("user_id"), "o_orderkey")
    rows = lambda k, level: o.where(F.col("o_orderkey") % k == 0).select("document_id", "user_id", F.lit(level).alias("permission_level"), F.lit(True).alias("is_active"))
    return lifecycle.remove_collaborator(lifecycle.add_collaborators(rows(3, "viewer").distinct(), rows(2, "editor")), 1, 1)


@query("SELECT event_id AS comment_id, event_type = 'click' OR event_id % 3 = 0 AS is_resolved FROM events")
def comments_resolved(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    comments = e.select(F.col("event_id").alias("comment_id"), (F.col("event_type") == "click").alias("is_resolved"))
    return lifecycle.resolve_comments(comments, e.where("event_id % 3 = 0").select(F.col("event_id").alias("comment_id")))


@query("SELECT activity, count(*) AS n FROM (SELECT event_type AS activity FROM events UNION ALL SELECT 'order' FROM orders) GROUP BY activity")
def activity_log(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").select(F.col("event_type").alias("activity"), F.col("ts").cast("timestamp").alias("at"))
    more = table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("at"), F.lit("order").alias("activity"), "o_orderkey")
    return lifecycle.append_activity(log, more).groupBy("activity").agg(F.count("*").alias("n"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 > 0 THEN lang END, source) AS label FROM documents")
def backfilled(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("label"), "source")
    return lifecycle.backfill(d, "label", F.col("source")).drop("source")


@query(f"SELECT 'local' AS provider, CASE WHEN k < 2 THEN 'a' ELSE 'b' END AS model, count(*) AS n FROM {VECTORS}, (SELECT unnest([0, 2, 3]) AS k) WHERE k = 2 AND chunk_id % 2 = 0 OR k = 3 AND chunk_id % 2 = 1 OR k = 0 AND chunk_id % 5 = 0 GROUP BY ALL")
def embedding_stats(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.embeddings(spark, sf).select("chunk_id", "embedding")
    mark = lambda df, m: df.withColumn("provider", F.lit("local")).withColumn("model", F.lit(m))
    known = mark(e.where("chunk_id % 5 = 0"), "a").unionByName(mark(e.where("chunk_id % 2 = 0"), "b"))
    return lifecycle.provider_counts(lifecycle.tagged(e, known, "local", "b"))


@query(f"SELECT id, {_STATUS.replace('doc_id', 'id')} IN ('not processed', 'extracted', 'chunked', 'processed') AS valid FROM {DOCS} UNION ALL SELECT -1, false")
def status_valid(spark: SparkSession, sf: str) -> DataFrame:
    d = tables.documents(spark, sf).select("id", "status").unionByName(spark.sql("SELECT -1L AS id, 'lost' AS status"))
    return d.select("id", lifecycle.valid_status(F.col("status")).alias("valid"))


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 8 = 4")
def pending_extraction(spark: SparkSession, sf: str) -> DataFrame:
    d = tables.documents(spark, sf).withColumn("content", F.when(F.col("id") % 8 != 4, F.col("content")))
    return lifecycle.pending(d).select("id")


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 10 >= 7 OR doc_id % 4 = 1")
def incremental_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = tables.documents(spark, sf).select("id", F.sha2("content", 256).alias("content_hash"))
    known = d.where("id % 10 < 7").withColumn("content_hash", F.when(F.col("id") % 4 == 1, "older").otherwise(F.col("content_hash")))
    return lifecycle.changed(d, known).select("id")


@query("SELECT event_id AS job_id, event_type AS queue, CAST(row_number() OVER (PARTITION BY event_type ORDER BY user_id % 5 DESC, ts, event_id) AS INT) AS place FROM events")
def job_queue(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_id").alias("job_id"), F.col("event_type").alias("queue"), (F.col("user_id") % 5).alias("priority"), F.col("ts").alias("created_at"))
    return lifecycle.queue(e).select("job_id", "queue", "place")


@query("SELECT c_custkey AS user_id FROM customer WHERE c_custkey % 3 <> 2")
def users_seen_by_admin(spark: SparkSession, sf: str) -> DataFrame:
    role = F.array(*map(F.lit, browse.ROLES))[(F.col("c_custkey") % 3).cast("int")]
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), role.alias("role")).where(browse.visible_users("admin")).select("user_id")


# first bytes (hex), extension and size of the files that the file checks see, by doc_id modulo their number
FILES = (
    ("4D5A90", "txt", 5000), ("7F454C46", "pdf", 5000), ("255044462D", "pdf", 5000), ("", "pdf", 5000), ("89504E470D0A1A0A", "png", 16 << 20), ("89504E470D0A1A0A", "png", 5000), ("504B0304", "docx", 21 << 20), ("", "docx", 5000),
    ("", "txt", 0), ("", "txt", 50), ("", "exe", 5000), ("00", "md", 5000), ("", "txt", 5000), ("255044462D", "pdf", 41 << 20), ("49492A00", "tiff", 5000), ("424D", "bmp", 5000), ("D0CF11E0A1B11AE1", "doc", 5000), ("", "csv", 11 << 20),
)
_REASONS = ("program", "program", None, "header", "bomb", None, "too_large", "header", "empty", "too_small", "type", "zero_byte", None, "bomb", None, None, None, "too_large")


@query(f"""SELECT doc_id, [{', '.join('NULL' if r is None else f"'{r}'" for r in _REASONS)}][CAST(doc_id % {len(FILES)} AS INT) + 1] AS problem, CASE doc_id % {len(FILES)} WHEN 10 THEN NULL ELSE
  [{', '.join(f"'{checks.MIME.get(f[1], '')}'" for f in FILES)}][CAST(doc_id % {len(FILES)} AS INT) + 1] END AS mime, doc_id % 7 = 0 AS malware FROM documents""")
def file_checks(spark: SparkSession, sf: str) -> DataFrame:
    kind = (F.col("doc_id") % len(FILES)).cast("int")
    pick = lambda i: F.array(*[F.lit(f[i]) for f in FILES])[kind]
    tail = F.concat(F.col("text"), F.when(F.col("doc_id") % 7 == 0, " CMD.exe /C x").otherwise("")).cast("binary")
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.unhex(pick(0)), tail).alias("content"), F.concat(F.lit("a.b."), pick(1)).alias("name"), pick(2).cast("long").alias("size"))
    mime = checks.mime_type(F.col("name"))
    return d.select("doc_id", checks.file_problem(F.col("content"), F.col("size"), mime).alias("problem"), mime.alias("mime"), checks.malware(F.col("content")).alias("malware"))


@query("SELECT event_type, round_even(avg(value), 4) AS mean, round_even(max(value), 4) AS highest, round_even(min(value), 4) AS lowest, count(*) AS n FROM events GROUP BY event_type")
def relevance_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return checks.relevance_ranges(table(spark, sf, "events"), "event_type", "value")


@query("""WITH l AS (SELECT event_id AS line, event_type, user_id % 50 AS s, user_id AS m FROM events), r AS (SELECT * FROM l ORDER BY line DESC LIMIT 10), ok AS (SELECT * FROM r WHERE line % 4 > 0)
  SELECT (SELECT count(*) FROM l) AS lines, least(10, (SELECT count(*) FROM l)) AS recent, round((SELECT sum(s) FROM ok) / 10.0, 6) AS mean_seconds, round((SELECT sum(m) FROM ok) / 10.0, 6) AS mean_memory,
  (SELECT string_agg(event_type || ':' || n, ',' ORDER BY event_type) FROM (SELECT event_type, count(*) AS n FROM ok GROUP BY 1)) AS methods""")
def performance_stats(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    bad = F.when(F.col("event_id") % 4 == 0, "x").otherwise("")
    value = F.concat(F.lit("2024 | f | Method: "), "event_type", F.lit(" | Time: "), bad, (F.col("user_id") % 50).cast("string"), F.lit("s | Memory: "), F.col("user_id").cast("string"), F.lit("MB | CPU: 1"))
    s = checks.performance_stats(e.select(F.col("event_id").alias("line"), value.alias("value")))
    methods = F.array_join(F.transform("methods", lambda m: F.concat(m["method"], F.lit(":"), m["m"].cast("string"))), ",")
    return s.select("lines", F.col("recent").cast("long").alias("recent"), F.round("mean_seconds", 6).alias("mean_seconds"), F.round("mean_memory", 6).alias("mean_memory"), methods.alias("methods"))


@query("SELECT event_type, count(*) AS n, round(avg(user_id), 6) AS mean_user FROM events WHERE event_id % 9 > 0 GROUP BY event_type")
def json_log_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    line = F.when(F.col("event_id") % 9 == 0, "{broken").otherwise(F.to_json(F.struct("event_type", "user_id", "value")))
    return checks.json_log(e.select(line.alias("value")), "event_type string, user_id long, value double").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("user_id"), 6).alias("mean_user"))


@query("""SELECT event_id, '"' || event_id || '","' || coalesce(replace(props, '"', '""'), '') || '","' || event_type || '"' AS line FROM events""")
def feedback_csv(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", checks.csv_line(F.col("event_id"), F.col("props"), F.col("event_type")).alias("line"))


_KINDS = "['upload', 'chat', 'api', 'extract', 'admin']"


@query(f"""WITH e AS (SELECT ts, user_id AS client, {_KINDS}[CAST(event_id % 5 AS INT) + 1] AS kind FROM events), s AS (SELECT *, CASE kind WHEN 'chat' THEN 60 ELSE 3600 END AS w, CASE kind WHEN 'upload' THEN 10 WHEN 'chat' THEN 60 WHEN 'api' THEN 1000 WHEN 'extract' THEN 20 ELSE 100 END AS most FROM e)
  SELECT kind, client, start, count(*) AS n, greatest(max(most) - count(*), 0) AS remaining, start + to_seconds(max(w)) AS reset FROM (SELECT *, to_timestamp(floor(epoch(ts) / w) * w)::TIMESTAMP AS start FROM s) GROUP BY kind, client, start""")
def limit_status(spark: SparkSession, sf: str) -> DataFrame:
    path = F.array(*[F.lit(p) for p in ("/api/documents/upload/1", "/api/chat/x", "/api/other", "/api/processing/y", "/api/admin")])[(F.col("event_id") % 5).cast("int")]
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("client"), limits.endpoint_type(path).alias("kind"))
    return limits.limit_status(e)


@query("""WITH e AS (SELECT user_id AS session_id, ts, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'complete' ELSE 'step' END AS kind FROM events),
  s AS (SELECT session_id, min(ts) FILTER (kind = 'start') AS start, count(*) FILTER (kind = 'step') AS done, max(kind = 'complete') AS complete FROM e GROUP BY 1)
  SELECT session_id, done, 40 AS total, round(done / 40 * 100, 6) AS percent, CASE WHEN complete THEN 'completed' WHEN done > 0 THEN 'processing' ELSE 'started' END AS status FROM s WHERE start >= TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 24 hours""")
def session_progress(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "complete").otherwise("step")
    e = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.lit(40).alias("total"))
    return limits.session_progress(e, F.lit("2024-01-10 00:00:00").cast("timestamp")).withColumn("percent", F.round("percent", 6))


@query("SELECT doc_id, CASE WHEN n_chars >= 900 THEN 'A' WHEN n_chars >= 800 THEN 'B' WHEN n_chars >= 700 THEN 'C' WHEN n_chars >= 600 THEN 'D' ELSE 'F' END AS grade, list_filter(string_split('[' || (doc_id % 9) || ', ' || n_chars || ']', 'z'), lambda x: true) AS raw FROM documents")
def grades(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("["), (F.col("doc_id") % 9).cast("string"), F.lit(", "), F.col("n_chars").cast("string"), F.lit("]"))
    d = table(spark, sf, "documents").select("doc_id", scores.grade(F.col("n_chars") / 1000).alias("grade"), t.json_ints(raw).alias("pages"))
    return d.select("doc_id", "grade", F.array(F.concat(F.lit("["), F.array_join(F.col("pages").cast("array<string>"), ", "), F.lit("]"))).alias("raw"))
