"""Rate limits, slow searches, running counters and sessions, over batches and streams alike.

Every function takes a batch or a streaming DataFrame; on a stream ``watermark`` bounds the state that late rows need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Requests allowed in a window of so many seconds, by kind of endpoint.
LIMITS = {"upload": (10, 3600), "chat": (60, 60), "api": (1000, 3600), "extract": (20, 3600), "admin": (100, 3600)}
# Seconds beyond which a search is slow.
SLOW = {"text": 0.5, "vector": 1.0, "hybrid": 1.5}


def late(df: DataFrame, at: str, watermark: str | None) -> DataFrame:
    return df.withWatermark(at, watermark) if watermark and df.isStreaming else df


def endpoint_type(path: Column) -> Column:
    """Kind of endpoint by the path's beginning."""
    out = F.lit("api")
    for prefix, kind in (("/api/admin", "admin"), ("/api/processing", "extract"), ("/api/chat", "chat"), ("/api/documents/upload", "upload")):
        out = F.when(F.startswith(path, F.lit(prefix)), kind).otherwise(out)
    return out


def window_counts(requests: DataFrame, seconds: int = 3600, limit: int = 1000, watermark: str | None = "1 hour") -> DataFrame:
    """(start, client, n, rejected, remaining) of requests (ts, client) in tumbling windows aligned to the epoch."""
    n = F.col("n")
    counts = late(requests, "ts", watermark).groupBy(F.window("ts", f"{seconds} seconds"), "client").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "client", "n", F.greatest(n - limit, F.lit(0)).alias("rejected"), F.greatest(limit - n, F.lit(0)).alias("remaining"))


def rejected_requests(requests: DataFrame, seconds: int = 3600, limit: int = 1000) -> DataFrame:
    """The single requests (ts, client, request_id) of a batch beyond the limit of their window, in order of time and id.

    Requests are numbered within their minute and the counts of earlier minutes added, so a busy client's window is many groups.
    """
    start = F.window("ts", f"{seconds} seconds")["start"]
    timed = requests.withColumn("start", start).withColumn("minute", F.date_trunc("minute", "ts"))
    counts = timed.groupBy("client", "start", "minute").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("client", "start").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    order = Window.partitionBy("client", "start", "minute").orderBy("ts", "request_id")
    placed = timed.withColumn("place", F.row_number().over(order)).join(counts.select("client", "start", "minute", before.alias("before")), ["client", "start", "minute"])
    return placed.withColumn("place", F.col("place") + F.col("before")).where(F.col("place") > limit).drop("before", "minute")


def slow_searches(searches: DataFrame, seconds: Column) -> DataFrame:
    """Searches slower than their type's threshold (stateless)."""
    threshold = F.create_map(*[F.lit(x) for kv in SLOW.items() for x in kv])[F.col("search_type")]
    return searches.withColumn("threshold", threshold).where(seconds > F.col("threshold"))


def running_counters(searches: DataFrame) -> DataFrame:
    """(search_type, n, mean_ms, successes) so far; on a stream in update or complete mode."""
    return searches.groupBy("search_type").agg(F.count("*").alias("n"), F.avg("response_time_ms").alias("mean_ms"), F.count_if(F.col("result_count") > 0).alias("successes"))


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str | None = "1 hour") -> DataFrame:
    """(user_id, start, end, n) of each user's events (ts, user_id) without a pause of ``gap``."""
    found = late(events, "ts", watermark).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def latest_state(log: DataFrame, key: str = "job_id", at: str = "ts", state: str = "status") -> DataFrame:
    """The last state of each job of an event log; ties go to the larger state."""
    return log.groupBy(key).agg(F.max_by(state, F.struct(at, state)).alias(state), F.max(at).alias(at))


def limit_status(requests: DataFrame, watermark: str | None = "1 hour") -> DataFrame:
    """(kind, client, start, n, remaining, reset) of requests (ts, client, kind): each kind of endpoint has its own limit and window (``LIMITS``); ``reset`` is the window's end."""
    seconds = F.create_map(*[F.lit(x) for k, (_, s) in LIMITS.items() for x in (k, s)])[F.col("kind")]
    most = F.create_map(*[F.lit(x) for k, (n, _) in LIMITS.items() for x in (k, n)])[F.col("kind")]
    start = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / seconds) * seconds)
    counts = late(requests, "ts", watermark).withColumn("start", start).groupBy("kind", "client", "start").agg(F.count("*").alias("n"))
    return counts.select("kind", "client", "start", "n", F.greatest(most - F.col("n"), F.lit(0)).alias("remaining"), F.timestamp_seconds(F.unix_timestamp("start") + seconds).alias("reset"))


def session_progress(events: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """(session_id, done, total, percent, status) of sessions not older than ``hours``, from events (session_id, ts, kind, total): kinds start, step, complete."""
    s = events.groupBy("session_id").agg(F.min(F.when(F.col("kind") == "start", F.col("ts"))).alias("start"), F.max("total").alias("total"), F.count_if(F.col("kind") == "step").alias("done"), F.max((F.col("kind") == "complete").cast("int")).alias("complete"))
    live = s.where(F.col("start") >= now - F.expr(f"interval {hours} hours"))
    percent = F.when(F.col("total") > 0, F.col("done") / F.col("total") * 100).otherwise(0.0)
    return live.select("session_id", "done", "total", percent.alias("percent"), F.when(F.col("complete") == 1, "completed").when(F.col("done") > 0, "processing").otherwise("started").alias("status"))
