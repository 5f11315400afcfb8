"""Queries of rate limits, slow searches, counters and sessions, and of tables in text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import tables as tb
from docloom.plans.registry import SEARCHES, query
from docloom.plans.retrieval import STRIP
from docloom.sources import tables
from docloom.streaming import limits


def requests(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.table(spark, sf, "events")
    return e.select(F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("client"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type AS client, count(*) AS n, greatest(count(*) - 3, 0) AS rejected, greatest(3 - count(*), 0) AS remaining FROM events GROUP BY 1, 2")
def rate_limit_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return limits.window_counts(requests(spark, sf), 3600, 3)


@query("SELECT event_id AS request_id, event_type AS client FROM events QUALIFY row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL 1 hour, ts) ORDER BY ts, event_id) > 3")
def rate_limit_rejected(spark: SparkSession, sf: str) -> DataFrame:
    return limits.rejected_requests(requests(spark, sf), 3600, 3).select("request_id", "client")


@query(f"SELECT search_id, search_type FROM {SEARCHES} WHERE response_time_ms / 100 > CASE search_type WHEN 'text' THEN 0.5 WHEN 'vector' THEN 1.0 WHEN 'hybrid' THEN 1.5 END")
def slow_search_flags(spark: SparkSession, sf: str) -> DataFrame:
    return limits.slow_searches(tables.searches(spark, sf), F.col("response_time_ms") / 100).select("search_id", "search_type")


@query(f"SELECT search_type, count(*) AS n, round(avg(response_time_ms), 4) AS mean_ms, count(*) FILTER (result_count > 0) AS successes FROM {SEARCHES} GROUP BY 1")
def running_counters(spark: SparkSession, sf: str) -> DataFrame:
    return limits.running_counters(tables.searches(spark, sf)).withColumn("mean_ms", F.round("mean_ms", 4))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minutes THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
  SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return limits.sessions(e).select("user_id", "start", "n")


@query("SELECT user_id AS job_id, max_by(event_type, (ts, event_type)) AS status FROM events GROUP BY 1")
def job_states(spark: SparkSession, sf: str) -> DataFrame:
    log = tables.table(spark, sf, "events").select(F.col("user_id").alias("job_id"), "ts", F.col("event_type").alias("status"))
    return limits.latest_state(log).select("job_id", "status")


_CELLS = f"list_transform(string_split(trim({STRIP.format(c='x')}, '|'), '|'), lambda y: {STRIP.format(c='y')})"
_BLOCKS = r"(SELECT doc_id, unnest(regexp_split_to_array(text, '\n\s*\n')) AS b, unnest(range(1, 1 + len(regexp_split_to_array(text, '\n\s*\n')))) AS i FROM documents)"
_PARSED = f"""(SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS "table", list_transform(l, lambda x: {_CELLS}) AS t
  FROM (SELECT doc_id, i, list_filter(string_split(b, chr(10)), lambda x: contains(x, '|') AND NOT contains(x, '---')) AS l FROM {_BLOCKS}) WHERE len(l) >= 2)"""


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return tb.parse(tables.table(spark, sf, "documents"), "doc_id", "text")


@query(f"""SELECT doc_id, "table", CAST(len(t[1]) AS INT) AS columns, CAST(len(t) - 1 AS INT) AS rows, array_to_string(t[1], '|') AS header FROM {_PARSED}""")
def md_table_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf).select("doc_id", "table", F.size("headers").alias("columns"), F.size("rows").alias("rows"), F.array_join("headers", "|").alias("header"))


@query(f"""WITH k AS (SELECT doc_id, "table", CASE WHEN n <= 5 AND m <= 4 THEN 'complete' WHEN n > 10 THEN 'horizontal' WHEN m > 6 THEN 'vertical' ELSE 'semantic' END AS strategy, n, m FROM (SELECT doc_id, "table", len(t) - 1 AS n, len(t[1]) AS m FROM {_PARSED})),
  s AS (SELECT *, CASE strategy WHEN 'vertical' THEN m ELSE n END AS size, CASE strategy WHEN 'horizontal' THEN 10 WHEN 'vertical' THEN 4 ELSE n END AS step FROM k)
  SELECT doc_id, "table", strategy, CAST(i AS INT) AS slice, CAST(i * step AS INT) AS first, CAST(least((i + 1) * step, size) - 1 AS INT) AS last FROM (SELECT *, unnest(range(0, CAST(ceil(size / step) AS BIGINT))) AS i FROM s)""")
def table_slices(spark: SparkSession, sf: str) -> DataFrame:
    return tb.slices(_parsed(spark, sf), "doc_id", "table")


_VALUE = """CASE WHEN regexp_matches(regexp_replace(v, '[,$%]', '', 'g'), '^-?\\d+(\\.\\d+)?$') THEN 1 WHEN contains(v, '%') THEN 2 WHEN contains(v, '$') OR contains(upper(v), 'USD') THEN 3
  WHEN regexp_matches(v, '""" + "|".join(tb.DATES) + """') THEN 4 ELSE 5 END"""


@query(f"""SELECT doc_id, "table", round(greatest(0, 1 - coalesce(len(list_filter(flatten(t[2:]), lambda v: v = '')) / nullif(len(flatten(t[2:])), 0), 0) - 0.1 * len(list_filter(t[2:], lambda r: len(r) <> len(t[1])))), 6) AS quality,
  CASE WHEN len(t) > 11 THEN 'very_complex' WHEN len(t) > 6 AND len(list_filter(t[2:], lambda r: len(r) > 5)) > 0 THEN 'complex' ELSE 'simple' END AS complexity,
  list_transform(range(1, len(t[1]) + 1), lambda i: coalesce(['numerical', 'percentage', 'currency', 'date', 'text'][list_min(list_transform(list_filter(t[2:], lambda r: len(r) >= i)[1:3], lambda r: list_transform([r[i]], lambda v: {_VALUE})[1]))], 'unknown')) AS types,
  CASE WHEN len(list_filter(t[2:], lambda r: len(r) <> len(t[2]))) = 0 THEN 0.9 WHEN len(list_filter(t[2:], lambda r: abs(len(r) - len(t[2])) > 1)) = 0 THEN 0.7 ELSE 0.5 END AS confidence FROM {_PARSED}""")
def table_quality(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.col("rows")
    return _parsed(spark, sf).select("doc_id", "table", F.round(tb.quality(F.col("headers"), rows), 6).alias("quality"), tb.complexity(rows).alias("complexity"), tb.column_types(F.col("headers"), rows).alias("types"), tb.layout_confidence(rows).alias("confidence"))
