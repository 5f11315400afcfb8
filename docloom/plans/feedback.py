"""Queries of feedback analytics and relevance tuning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import feedback as fb
from docloom.plans.registry import FEEDBACK, query
from docloom.sources import tables

_TYPES = "['positive', 'negative', 'neutral', 'click', 'skip']"
_RATES = f"""(SELECT query_id, count(*) AS searches, CASE WHEN count(*) FILTER (feedback_type <> 'neutral' AND feedback_type <> 'skip') = 0 THEN 0
  ELSE count(*) FILTER (feedback_type IN ('positive', 'click')) / count(*) FILTER (feedback_type NOT IN ('neutral', 'skip')) END AS success_rate FROM {FEEDBACK} WHERE query_id IS NOT NULL GROUP BY query_id)"""
_STATS = f"""(SELECT count(*) AS total, {', '.join(f"count(*) FILTER (feedback_type = '{x}') / count(*) AS {x}" for x in fb.TYPES)},
  (SELECT avg(success_rate) FROM {_RATES}) AS success FROM {FEEDBACK})"""
_RATED = f"(SELECT {list(fb.CATEGORIES)}[CAST(event_id % 5 AS INT) + 1] AS category, CAST(1 + event_id % 7 % 5 AS INT) AS rating FROM events)"


def _rated(spark: SparkSession, sf: str) -> DataFrame:
    """(category, rating): the events as ratings of five of the six categories."""
    e = tables.table(spark, sf, "events")
    return e.select(F.array(*map(F.lit, fb.CATEGORIES))[(F.col("event_id") % 5).cast("int")].alias("category"), (1 + F.col("event_id") % 7 % 5).cast("int").alias("rating"))


@query(f"""SELECT t.feedback_type, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM events), 6) AS ratio
  FROM (SELECT unnest({_TYPES}) AS feedback_type) t LEFT JOIN (SELECT feedback_type, count(*) AS n FROM {FEEDBACK} GROUP BY 1) USING (feedback_type)""")
def feedback_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return fb.type_ratios(tables.feedback(spark, sf)).withColumn("ratio", F.round("ratio", 6))


@query(f"SELECT query_id, searches, round(success_rate, 6) AS success_rate FROM {_RATES}")
def query_success_rates(spark: SparkSession, sf: str) -> DataFrame:
    return fb.success_rates(tables.feedback(spark, sf)).withColumn("success_rate", F.round("success_rate", 6))


@query(f"""SELECT unnest(list_filter([CASE WHEN positive < 0.3 THEN 'low_positive_feedback' END, CASE WHEN negative > 0.4 THEN 'high_negative_feedback' END, CASE WHEN success < 0.5 THEN 'low_success_rate' END,
  CASE WHEN total < 10 THEN 'insufficient_data' END], lambda x: x IS NOT NULL)) AS issue FROM {_STATS}""")
def relevance_issues(spark: SparkSession, sf: str) -> DataFrame:
    return fb.issues(fb.summary(tables.feedback(spark, sf))).select("issue")


@query(f"""WITH s AS (SELECT *, CAST(positive < 0.3 AS INT) + CAST(negative > 0.4 AS INT) AS critical FROM {_STATS}), t AS (SELECT critical, CASE WHEN negative > 0.3 THEN least(0.1 * negative, 0.3) ELSE 0 END AS sd,
  CASE WHEN positive < 0.4 THEN 0.6 WHEN positive > 0.8 THEN 0.8 ELSE 0.7 END AS ex, CASE WHEN click < 0.2 THEN 30 WHEN click > 0.6 THEN 15 ELSE 20 END AS depth,
  (CASE WHEN negative > 0.3 THEN least(2 * negative, 1) ELSE 0 END + 0.7 + 0.6) / 3 AS sure FROM s)
  SELECT round(sd, 6) AS semantic_delta, round(ex, 6) AS expansion_threshold, CAST(depth AS INT) AS rerank_depth, round(least(0.1, 0.05 + 0.02 * critical), 6) AS embedding_strength,
  round(least(sure * (1 - 0.1 * critical), 1), 6) AS effectiveness FROM t""")
def tuning_params(spark: SparkSession, sf: str) -> DataFrame:
    t = fb.tuning(fb.summary(tables.feedback(spark, sf)))
    return t.select(*[F.round(c, 6).alias(c) for c in ("semantic_delta", "expansion_threshold", "embedding_strength", "effectiveness")], "rerank_depth")


@query(f"""WITH w AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in fb.CATEGORIES.items())}) AS w(category, weight)), r AS (SELECT category, count(*) AS n, avg(rating) AS m, avg(rating - 3) AS x FROM {_RATED} GROUP BY 1)
  SELECT w.category, coalesce(n, 0) AS n, round(m, 6) AS mean_rating, round(x, 6) AS weighted, round((1 - (x + 2) / 4) * weight, 6) AS priority FROM w LEFT JOIN r USING (category)""")
def improvement_priorities(spark: SparkSession, sf: str) -> DataFrame:
    p = fb.category_priorities(_rated(spark, sf))
    return p.select("category", "n", *[F.round(c, 6).alias(c) for c in ("mean_rating", "weighted", "priority")])


@query(f"""SELECT count(*) AS n, round(0.4 * least(count(*) / 5, 1) + 0.3 * (avg(rating) - 1) / 4 + 0.3 * (1 - abs(count(*) FILTER (rating >= 4) - count(*) FILTER (rating <= 2)) / count(*)), 6) AS confidence FROM {_RATED}""")
def feedback_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return fb.feedback_confidence(_rated(spark, sf)).withColumn("confidence", F.round("confidence", 6))


_ISSUES = f"""(SELECT unnest(list_filter([CASE WHEN positive < 0.3 THEN 'low_positive_feedback' END, CASE WHEN negative > 0.4 THEN 'high_negative_feedback' END, CASE WHEN success < 0.5 THEN 'low_success_rate' END,
  CASE WHEN total < 10 THEN 'insufficient_data' END], lambda x: x IS NOT NULL)) AS issue FROM {_STATS})"""
_REMEDIES = "(SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{s}', '{p}')" for k, (s, p) in fb.REMEDIES.items()) + ") AS r(issue, strategy, priority))"


@query(f"SELECT strategy, priority FROM {_ISSUES} JOIN {_REMEDIES} USING (issue) UNION ALL SELECT 'hybrid', 'medium' WHERE NOT EXISTS (SELECT * FROM {_ISSUES} JOIN {_REMEDIES} USING (issue))")
def tuning_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    return fb.recommendations(fb.issues(fb.summary(tables.feedback(spark, sf))))


@query(f"""SELECT CASE WHEN n = 0 THEN 'good' ELSE 'needs_attention' END AS health, n AS issues, critical, round(positive, 6) AS positive, CASE WHEN n = 0 THEN 'monitor' ELSE 'tune' END AS advice
  FROM (SELECT count(*) AS n, count(*) FILTER (issue IN ('low_positive_feedback', 'high_negative_feedback')) AS critical FROM {_ISSUES}), {_STATS}""")
def relevance_health(spark: SparkSession, sf: str) -> DataFrame:
    s = fb.summary(tables.feedback(spark, sf))
    return fb.health(s, fb.issues(s)).withColumn("positive", F.round("positive", 6))


@query("SELECT CASE WHEN e < 0.3 THEN 'additional_tuning' ELSE 'monitoring' END AS type, CASE WHEN e < 0.3 THEN 'high' ELSE 'medium' END AS priority, count(*) AS n FROM (SELECT event_id % 11 / 10 AS e FROM events) WHERE e < 0.3 OR e > 0.7 GROUP BY ALL")
def post_tuning(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.table(spark, sf, "events").select((F.col("event_id") % 11 / 10).alias("effectiveness"))
    return fb.after_tuning(e).groupBy("type", "priority").agg(F.count("*").alias("n"))


@query(f"""SELECT category, CASE WHEN p > 0.3 THEN 'high' WHEN p > 0.15 THEN 'medium' ELSE 'low' END AS level, n, round(m, 6) AS mean_rating FROM (SELECT w.category, n, m, (1 - (x + 2) / 4) * weight AS p FROM
  (SELECT * FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in fb.CATEGORIES.items())}) AS w(category, weight)) w JOIN (SELECT category, count(*) AS n, avg(rating) AS m, avg(rating - 3) AS x FROM {_RATED} GROUP BY 1) r USING (category) ORDER BY round(p, 9) DESC, w.category LIMIT 3) WHERE p > 0.1
  UNION ALL SELECT 'general', 'medium', count(*), round(avg(rating), 6) FROM {_RATED} HAVING avg(rating) < 3""")
def citation_advice(spark: SparkSession, sf: str) -> DataFrame:
    return fb.category_advice(fb.category_priorities(_rated(spark, sf))).withColumn("mean_rating", F.round("mean_rating", 6))


@query("SELECT user_id, event_id AS feedback_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS INT) AS place FROM events")
def feedback_history(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("timestamp"), "feedback_id")
    return tables.feedback(spark, sf).select("user_id", "feedback_id", F.row_number().over(w).alias("place"))


@query("SELECT arm, count(*) AS users FROM (SELECT DISTINCT user_id, CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 2 AS arm FROM events) GROUP BY arm")
def ab_arms(spark: SparkSession, sf: str) -> DataFrame:
    users = tables.feedback(spark, sf).select("user_id").distinct()
    return users.groupBy(fb.assignment(F.col("user_id")).cast("long").alias("arm")).agg(F.count("*").alias("users"))


@query(f"SELECT feedback_type, count(*) AS n, count(DISTINCT query_id) AS queries FROM {FEEDBACK} GROUP BY feedback_type")
def feedback_queries(spark: SparkSession, sf: str) -> DataFrame:
    return tables.feedback(spark, sf).groupBy("feedback_type").agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("queries"))
