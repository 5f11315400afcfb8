"""Feedback analytics and relevance tuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ("positive", "negative", "neutral", "click", "skip")
# Category weights, and what a rating of 1 to 5 weighs.
CATEGORIES = {"citation_accuracy": 0.25, "source_reliability": 0.20, "context_relevance": 0.20, "formatting": 0.15, "completeness": 0.10, "usability": 0.10}
RATINGS = {1: -2, 2: -1, 3: 0, 4: 1, 5: 2}


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def type_ratios(feedback: DataFrame) -> DataFrame:
    """(feedback_type, n, ratio) of every type, absent ones with 0; one pre-aggregated shuffle."""
    spark = feedback.sparkSession
    types = F.broadcast(spark.sql("SELECT explode(array(" + ", ".join(f"'{x}'" for x in TYPES) + ")) AS feedback_type"))  # five rows
    found = feedback.groupBy("feedback_type").agg(F.count("*").alias("n"))
    total = feedback.agg(F.count("*").alias("total"))
    return types.join(found, "feedback_type", "left").crossJoin(F.broadcast(total)).select("feedback_type", F.coalesce("n", F.lit(0)).alias("n"), _share(F.coalesce("n", F.lit(0)).cast("double"), F.col("total")).alias("ratio"))


def success_rates(feedback: DataFrame) -> DataFrame:
    """(query_id, searches, success_rate): (positive + click) / (positive + negative + click), 0 without any of them."""
    good, bad = F.col("feedback_type").isin("positive", "click"), F.col("feedback_type") == "negative"
    n = feedback.where(F.col("query_id").isNotNull()).groupBy("query_id").agg(F.count("*").alias("searches"), F.count_if(good).alias("good"), F.count_if(bad).alias("bad"))
    return n.select("query_id", "searches", _share(F.col("good").cast("double"), F.col("good") + F.col("bad")).alias("success_rate"))


def summary(feedback: DataFrame) -> DataFrame:
    """One row: total, the share of each type, the mean success rate of queries."""
    shares = [_share(F.count_if(F.col("feedback_type") == x).cast("double"), F.count("*")).alias(x) for x in TYPES]
    rates = success_rates(feedback).agg(F.coalesce(F.avg("success_rate"), F.lit(0.0)).alias("success"))
    return feedback.agg(F.count("*").alias("total"), *shares).crossJoin(rates)  # one row each


def issues(stats: DataFrame) -> DataFrame:
    """(issue, severity) found in a ``summary`` row."""
    found = [
        (F.col("positive") < 0.3, "low_positive_feedback", "high"), (F.col("negative") > 0.4, "high_negative_feedback", "high"),
        (F.col("success") < 0.5, "low_success_rate", "medium"), (F.col("total") < 10, "insufficient_data", "low"),
    ]
    each = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("issue"), F.lit(s).alias("severity"))) for c, i, s in found]))
    return stats.select(F.explode(each).alias("x")).select("x.*")


def tuning(stats: DataFrame) -> DataFrame:
    """One row of tuned parameters: fusion weights, expansion threshold, rerank depth, embedding strength, and the tuning's confidence and effect."""
    neg, pos, click = F.col("negative"), F.col("positive"), F.col("click")
    critical = (pos < 0.3).cast("int") + (neg > 0.4).cast("int")
    semantic = F.when(neg > 0.3, F.least(neg * 0.1, F.lit(0.3))).otherwise(0.0)
    expansion = F.when(pos < 0.4, F.greatest(F.lit(0.7 - 0.1), F.lit(0.5))).when(pos > 0.8, F.least(F.lit(0.7 + 0.1), F.lit(0.9))).otherwise(0.7)
    depth = F.when(click < 0.2, F.least(F.lit(20 + 10), F.lit(50))).when(click > 0.6, F.greatest(F.lit(20 - 5), F.lit(10))).otherwise(20)
    sure = (F.when(neg > 0.3, F.least(neg * 2, F.lit(1.0))).otherwise(0.0) + 0.7 + 0.6) / 3
    effect = F.least(sure * (1 - critical * 0.1), F.lit(1.0))
    return stats.select(
        semantic.alias("semantic_delta"), (-semantic / 2).alias("lexical_delta"), expansion.alias("expansion_threshold"), depth.alias("rerank_depth"),
        F.least(F.lit(0.1), critical * 0.02 + 0.05).alias("embedding_strength"), sure.alias("confidence"), effect.alias("effectiveness"),
        F.when(effect > 0.7, "high").when(effect > 0.4, "medium").otherwise("low").alias("effect"),
    )


def category_priorities(ratings: DataFrame) -> DataFrame:
    """(category, n, mean_rating, weighted, priority) of every category from (category, rating); the priority is null without ratings."""
    spark = ratings.sparkSession
    weights = F.broadcast(spark.createDataFrame(list(CATEGORIES.items()), "category string, weight double"))
    value = F.create_map(*[F.lit(x) for kv in RATINGS.items() for x in kv])[F.col("rating")]
    found = ratings.groupBy("category").agg(F.count("*").alias("n"), F.avg("rating").alias("mean_rating"), F.avg(value).alias("weighted"))
    return weights.join(found, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"), "mean_rating", "weighted", ((1 - (F.col("weighted") + 2) / 4) * F.col("weight")).alias("priority"))


def feedback_confidence(ratings: DataFrame) -> DataFrame:
    """One row: .4 for five or more ratings, .3 for their mean, .3 for praise and blame in balance; 0 without ratings."""
    n = F.count("*")
    lean = F.abs(F.count_if(F.col("rating") >= 4) - F.count_if(F.col("rating") <= 2)) / n
    score = F.least(n / 5, F.lit(1.0)) * 0.4 + (F.avg("rating") - 1) / 4 * 0.3 + (1 - lean) * 0.3
    return ratings.agg(n.alias("n"), F.when(n == 0, 0.0).otherwise(score).alias("confidence"))


def assignment(user: Column, arms: int = 2) -> Column:
    """A stable arm of an A/B test for each user."""
    return (F.conv(F.substring(F.md5(user.cast("string")), 1, 8), 16, 10).cast("long") % arms).cast("int")


# What to do about an issue: (strategy, priority).
REMEDIES = {"low_positive_feedback": ("weight_adjustment", "high"), "high_negative_feedback": ("query_expansion", "high"), "low_success_rate": ("reranking", "medium")}


def recommendations(found: DataFrame) -> DataFrame:
    """(strategy, priority) for each of the ``issues``; a hybrid one where none has a remedy."""
    known = F.create_map(*[x for k, (s, p) in REMEDIES.items() for x in (F.lit(k), F.struct(F.lit(s).alias("strategy"), F.lit(p).alias("priority")))])
    each = F.collect_list(known[F.col("issue")])
    other = F.array(F.struct(F.lit("hybrid").alias("strategy"), F.lit("medium").alias("priority")))
    return found.agg(each.alias("r")).select(F.explode(F.when(F.size("r") > 0, F.col("r")).otherwise(other)).alias("x")).select("x.*")


def health(stats: DataFrame, found: DataFrame) -> DataFrame:
    """One row: overall health, number of issues and of critical (high) ones, positive share, advice."""
    n = found.agg(F.count("*").alias("issues"), F.count_if(F.col("severity") == "high").alias("critical"))
    good = F.col("issues") == 0
    return n.crossJoin(stats.select("positive")).select(
        F.when(good, "good").otherwise("needs_attention").alias("health"), "issues", "critical", "positive", F.when(good, "monitor").otherwise("tune").alias("advice")
    )  # one row each


def after_tuning(tuned: DataFrame) -> DataFrame:
    """(type, priority) after a tuning: other strategies where little improvement is expected, monitoring where much is."""
    e = F.col("effectiveness")
    found = F.when(e < 0.3, F.array(F.struct(F.lit("additional_tuning").alias("type"), F.lit("high").alias("priority")))).when(e > 0.7, F.array(F.struct(F.lit("monitoring").alias("type"), F.lit("medium").alias("priority"))))
    return tuned.select(F.explode(found).alias("x")).select("x.*")


def category_advice(priorities: DataFrame, k: int = 3, least: float = 0.1) -> DataFrame:
    """(category, level, n, mean_rating) of the ``k`` most pressing categories above ``least``; ``general`` rows where there are no ratings or their mean is below 3."""
    level = F.when(F.col("priority") > 0.3, "high").when(F.col("priority") > 0.15, "medium").otherwise("low")
    top = priorities.where(F.col("priority").isNotNull()).orderBy(F.desc(F.round("priority", 9)), "category").limit(k).where(F.col("priority") > least).select("category", level.alias("level"), "n", "mean_rating")
    total, mean = F.sum("n"), F.sum(F.col("n") * F.coalesce("mean_rating", F.lit(0.0))) / F.sum("n")
    whole = priorities.agg(total.alias("n"), mean.alias("mean_rating")).where("n = 0 or mean_rating < 3")
    return top.unionByName(whole.select(F.lit("general").alias("category"), F.when(F.col("n") == 0, "high").otherwise("medium").alias("level"), "n", "mean_rating"))
