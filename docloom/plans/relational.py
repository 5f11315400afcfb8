"""Queries over documents and their relations: search, pages, statistics, access, lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import browse, lifecycle
from docloom.plans.registry import DOCS, FEEDBACK, SEARCHES, VECTORS, query
from docloom.sources.tables import documents, embeddings, feedback, searches, table


@query(f"""SELECT id, filename, file_size, status, created_at FROM {DOCS} WHERE content ILIKE '%the%' AND status = 'processed' AND mime_type ILIKE '%en%'
  AND created_at >= TIMESTAMP '2024-01-05 00:00:00' AND file_size >= 100 ORDER BY file_size DESC, id LIMIT 20 OFFSET 20""")
def doc_search_filtered(spark: SparkSession, sf: str) -> DataFrame:
    keep = browse.contains_text(" the ") & browse.filters("processed", "en", "2024-01-05T00:00:00Z", "soon", "100", "many")
    return browse.page(documents(spark, sf).where(keep), 2, 20, "file_size").select("id", "filename", "file_size", "status", "created_at")


@query(f"""SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages, 60 < count(*) AS has_next, true AS has_prev
  FROM {DOCS} WHERE status = 'processed'""")
def doc_page_meta(spark: SparkSession, sf: str) -> DataFrame:
    return browse.page_meta(documents(spark, sf).where(browse.filters("processed")), 3, 20)


@query(f"""SELECT mime_type, count(*) AS n, round(avg(file_size), 6) AS avg_size, min(file_size) AS min_size, max(file_size) AS max_size
  FROM {DOCS} GROUP BY mime_type""")
def doc_stats_by_type(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    return d.groupBy("mime_type").agg(F.count("*").alias("n"), F.round(F.avg("file_size"), 6).alias("avg_size"), F.min("file_size").alias("min_size"), F.max("file_size").alias("max_size"))


@query(f"SELECT status, count(*) AS n FROM {DOCS} GROUP BY status")
def doc_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT mime_type, count(*) AS n FROM {DOCS} GROUP BY mime_type ORDER BY n DESC, mime_type LIMIT 10")
def doc_top_types(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).groupBy("mime_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "mime_type").limit(10)


@query(f"""SELECT coalesce(round(avg(file_size), 6), 0) AS avg_size, coalesce(max(file_size), 0) AS max_size, coalesce(min(file_size), 0) AS min_size FROM {DOCS}""")
def doc_size_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).agg(F.avg("file_size").alias("a"), F.max("file_size").alias("x"), F.min("file_size").alias("m"))
    return d.select(F.coalesce(F.round("a", 6), F.lit(0.0)).alias("avg_size"), F.coalesce("x", F.lit(0)).alias("max_size"), F.coalesce("m", F.lit(0)).alias("min_size"))


@query(f"""SELECT DISTINCT suggestion FROM (SELECT filename AS suggestion FROM {DOCS} WHERE filename ILIKE '%tion%' UNION
  SELECT array_to_string(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')[1:5], ' ') || '...' FROM {DOCS} WHERE content ILIKE '%tion%')
  ORDER BY suggestion LIMIT 10""")
def suggestions(spark: SparkSession, sf: str) -> DataFrame:
    return browse.suggestions(documents(spark, sf), "tion")


@query(f"SELECT id, CASE WHEN length(content) > 200 THEN content[1:200] || '...' ELSE content END AS preview FROM {DOCS}")
def doc_previews(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("id", browse.preview(F.col("content")).alias("preview"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def chunk_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def docs_without_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def labelled_docs_join(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic")


@query(f"""SELECT v.chunk_id, d.id AS document_id, d.filename, l.quality FROM {VECTORS} v JOIN {DOCS} d ON v.document_id = d.id JOIN labels l ON l.doc_id = d.id""")
def three_way_join(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"), "quality")
    docs = documents(spark, sf).select(F.col("id").alias("document_id"), "filename")
    return embeddings(spark, sf).select("chunk_id", "document_id").join(docs, "document_id").join(labels, "document_id").select("chunk_id", "document_id", "filename", "quality")


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS version_number FROM orders")
def version_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.number_versions(table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "version_number")


@query("SELECT o_custkey AS user_id, max(o_orderdate) AS last_at, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_key FROM orders GROUP BY o_custkey")
def latest_per_user(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("last_at"), F.col("o_orderkey").alias("last_key"))
    return lifecycle.latest_state(jobs, "user_id", "last_at")


@query(f"SELECT id, filename FROM {DOCS} WHERE user_id = 7")
def acl_filter(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).where(browse.acl(7, "user")).select("id", "filename")


@query("""SELECT c.c_custkey AS user_id, CASE c.c_custkey % 4 WHEN 0 THEN 'viewer' WHEN 1 THEN 'editor' WHEN 2 THEN 'owner' END AS level,
  coalesce(CASE c.c_custkey % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true END, false) AS may_write FROM customer c""")
def collaborator_permissions(spark: SparkSession, sf: str) -> DataFrame:
    level = F.when(F.col("c_custkey") % 4 == 0, "viewer").when(F.col("c_custkey") % 4 == 1, "editor").when(F.col("c_custkey") % 4 == 2, "owner")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), level.alias("level"), browse.permitted(["write"], browse.level_permissions(level)).alias("may_write"))


@query(f"""WITH doomed AS (SELECT id FROM {DOCS} WHERE status = 'not processed') SELECT
  (SELECT count(*) FROM {DOCS} WHERE id NOT IN (SELECT id FROM doomed)) AS documents, (SELECT count(*) FROM {VECTORS} WHERE document_id NOT IN (SELECT id FROM doomed)) AS embeddings,
  (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT id FROM doomed)) AS labels""")
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    left = lifecycle.cascade_delete(
        docs.where("status = 'not processed'"), {"documents": (docs, "id"), "embeddings": (embeddings(spark, sf), "document_id"), "labels": (table(spark, sf, "labels"), "doc_id")}
    )
    counted = [df.agg(F.count("*").alias(name)) for name, df in left.items()]
    return counted[0].crossJoin(counted[1]).crossJoin(counted[2])  # three rows of one count each


@query(f"""SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM {DOCS}) AS documents, (SELECT count(*) FROM {VECTORS}) AS embeddings,
  (SELECT count(*) FROM conversations) AS messages, (SELECT count(DISTINCT user_id) FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE) AS active_sessions""")
def system_stats(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    active = events.crossJoin(F.broadcast(events.agg(F.max("ts").alias("now")))).where("ts > now - INTERVAL 30 MINUTES").agg(F.countDistinct("user_id").alias("active_sessions"))
    out = active
    for name, df in (("users", table(spark, sf, "customer")), ("documents", documents(spark, sf)), ("embeddings", embeddings(spark, sf)), ("messages", table(spark, sf, "conversations"))):
        out = out.crossJoin(df.agg(F.count("*").alias(name)))
    return out


@query(f"""SELECT a.status AS now, b.status AS next, coalesce((a.status, b.status) IN (('not processed', 'extracted'), ('extracted', 'chunked'), ('chunked', 'processed')), false) AS legal
  FROM (SELECT DISTINCT status FROM {DOCS}) a, (SELECT DISTINCT status FROM {DOCS}) b""")
def status_transition(spark: SparkSession, sf: str) -> DataFrame:
    states = documents(spark, sf).select("status").distinct()
    return states.select(F.col("status").alias("now")).crossJoin(states.select(F.col("status").alias("next"))).withColumn("legal", lifecycle.may_move(F.col("now"), F.col("next")))


@query(f"SELECT query_id, count(*) AS search_count, min(created_at) AS first_seen, max(created_at) AS last_seen FROM {SEARCHES} GROUP BY query_id")
def query_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.upsert_counts(searches(spark, sf), "query_id", "created_at").select("query_id", "search_count", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"))


@query("""SELECT d.doc_id AS id, length(d.text) AS content_length, coalesce(e.n, 0) AS embedding_count, coalesce(l.n, 0) AS label_count FROM documents d
  LEFT JOIN (SELECT CAST(label AS BIGINT) AS id, count(*) AS n FROM embeddings GROUP BY 1) e ON e.id = d.doc_id LEFT JOIN (SELECT doc_id AS id, count(*) AS n FROM labels GROUP BY 1) l ON l.id = d.doc_id""")
def processing_status(spark: SparkSession, sf: str) -> DataFrame:
    e = embeddings(spark, sf).groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("e"))
    n = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("l"))
    d = documents(spark, sf).select("id", F.length("content").cast("long").alias("content_length"))
    return d.join(e, "id", "left").join(n, "id", "left").select("id", "content_length", F.coalesce("e", F.lit(0)).alias("embedding_count"), F.coalesce("l", F.lit(0)).alias("label_count"))


@query(f"""SELECT 'content without labels' AS kind, count(*) AS n FROM {DOCS} WHERE content IS NOT NULL AND id NOT IN (SELECT doc_id FROM labels) UNION ALL
  SELECT 'label without document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = documents(spark, sf).select(F.col("id").alias("doc_id"), "content"), table(spark, sf, "labels")
    missing = docs.where("content is not null").join(labels, "doc_id", "left_anti").agg(F.lit("content without labels").alias("kind"), F.count("*").alias("n"))
    return missing.unionByName(labels.join(docs, "doc_id", "left_anti").agg(F.lit("label without document").alias("kind"), F.count("*").alias("n")))


@query("""SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS returned, sum(l_quantity) AS total_size, count(DISTINCT l_suppkey) AS owners FROM lineitem""")
def ui_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.sum("l_quantity").alias("total_size"), F.countDistinct("l_suppkey").alias("owners"))


@query(f"""SELECT d.id, d.filename, c.c_name AS owner FROM {DOCS} d LEFT JOIN customer c ON c.c_custkey = d.user_id""")
def docs_with_owner(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("owner"))
    return documents(spark, sf).select("id", "filename", "user_id").join(users, "user_id", "left").select("id", "filename", "owner")


@query(f"""SELECT f.query_id, s.search_count, count(*) AS judgements FROM {FEEDBACK} f JOIN (SELECT query_id, count(*) AS search_count FROM {SEARCHES} GROUP BY 1) s ON s.query_id = f.query_id
  GROUP BY f.query_id, s.search_count""")
def queries_with_feedback(spark: SparkSession, sf: str) -> DataFrame:
    counts = searches(spark, sf).groupBy("query_id").agg(F.count("*").alias("search_count"))
    judged = feedback(spark, sf).groupBy("query_id").agg(F.count("*").alias("judgements"))
    return judged.join(counts, "query_id").select("query_id", "search_count", "judgements")


@query("""SELECT md5(text) AS content_hash, sha256(text) AS file_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1, 2 HAVING count(*) > 1""")
def hash_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("content_hash"), F.sha2("text", 256).alias("file_hash"))
    return d.groupBy("content_hash", "file_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("""WITH q AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders) SELECT o_custkey, o_orderkey, o_orderdate FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM q) WHERE r <= 3""")
def recent_histories(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, sf, "orders").withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_custkey", "o_orderkey", "o_orderdate")
