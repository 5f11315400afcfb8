"""Streams that keep state of their own: limits request by request, sessions that expire, jobs that obey their life cycle.

Each processor waits with a row until the watermark has passed it, then takes its key's rows in order of time, so what a stream
decides does not depend on how its rows were cut into batches and is what the batch functions of ``limits`` and ``jobs`` say.
Rows later than the watermark are dropped, as in every stateful operator; state goes when its timer fires.
A key's state is as large as what arrives for it within the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.streaming.limits import LIMITS

# Requests and seconds of each role; an unknown role is a basic one.
ROLES = {"basic": (100, 3600), "premium": (1000, 3600), "admin": (5000, 3600)}
# Progress that a job has with each step, legal next states, and the retries that a failed job has.
PROGRESS = {"queued": 0, "processing": 10, "extracted": 40, "chunked": 70, "completed": 100}
MOVES = {
    None: ("queued",), "queued": ("processing", "failed"), "processing": ("extracted", "failed"), "extracted": ("chunked", "failed"), "chunked": ("completed", "failed"),
    "completed": (), "failed": ("queued",),
}
RETRIES = 3


def limited(requests: DataFrame, by: str = "kind", limits: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """``requests`` with ``most`` and ``seconds`` by their kind of endpoint (others: ``api``) or, with ``by="role"``, by role (others: ``basic``)."""
    table, other = (limits or LIMITS, "api") if by == "kind" else (limits or ROLES, "basic")

    def of(i: int) -> Column:
        return F.coalesce(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v[i])])[F.col(by)], F.lit(table[other][i]))

    return requests.withColumn("most", of(0)).withColumn("seconds", of(1))


def decide(requests: DataFrame) -> DataFrame:
    """Each request (request_id, ts, client, kind, most, seconds) of a batch with ``accepted`` and ``remaining``.

    Windows are aligned to the epoch and apart by client, kind and length; requests count in order of time and id.  They are numbered
    within their minute and the counts of earlier minutes added, so a busy client's window is many groups.
    """
    start = F.floor(F.unix_timestamp("ts") / F.col("seconds")) * F.col("seconds")
    timed = requests.withColumn("_start", start).withColumn("_minute", F.date_trunc("minute", "ts"))
    window = ["client", "kind", "seconds", "_start"]
    counts = timed.groupBy(*window, "_minute").agg(F.count("*").alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(*window).orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(*window, "_minute").orderBy("ts", "request_id"))
    placed = timed.withColumn("_place", place).join(counts.select(*window, "_minute", before.alias("_before")), [*window, "_minute"])
    n = F.col("_place") + F.col("_before")
    return placed.select("request_id", "ts", "client", "kind", (n <= F.col("most")).alias("accepted"), F.greatest(F.col("most") - n, F.lit(0)).cast("int").alias("remaining"))


def _millis(at: datetime) -> int:
    return round((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)


class _Ordered(StatefulProcessor):
    """Rows of a key wait, as (milliseconds, row), until the watermark has passed them; ``take`` gets them in order.

    Subclasses name the waiting columns (``WAITING``, the first is the time) and the rest of their state.
    """

    WAITING = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fields = [f.split(" ") for f in self.WAITING.split(", ")]
        kinds = [str if kind == "string" else int for _, kind in fields]  # a column with nulls comes as floats
        parts = (part[[name for name, _ in fields]].astype(object) for part in rows)
        new = [tuple(None if pd.isna(x) else kind(x) for x, kind in zip(r, kinds, strict=True)) for part in parts for r in part.itertuples(index=False)]
        self.waiting.appendList(new)
        self.handle.registerTimer(max(min(r[0] for r in new), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], *(("", "") if x is None else (type(x).__name__, x) for x in r[1:])))
        due, later = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0])
        else:
            self.waiting.clear()
        yield from self.take(key, due, now)

    def take(self, key, due: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Limiter(_Ordered):
    """Counts of the windows of one client and kind; a window's count goes once the watermark has left it."""

    WAITING = "at bigint, request_id bigint, most int, seconds int"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.counts = handle.getMapState("counts", "start bigint, seconds int", "n int")

    def take(self, key, due: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        counts = {(k[0], k[1]): v[0] for k, v in self.counts.iterator()}
        before, out = set(counts), []
        for at, request, most, seconds in due:
            window = (at // 1000 // seconds * seconds, seconds)
            n = counts[window] = counts.get(window, 0) + 1
            out.append((request, pd.Timestamp(at, unit="ms"), key[0], key[1], n <= most, max(most - n, 0)))
        ends = {w: (w[0] + w[1]) * 1000 for w in counts}
        for window, n in counts.items():
            if ends[window] > now:
                self.counts.updateValue(window, (n,))
            elif window in before:
                self.counts.removeKey(window)
        if left := [end for end in ends.values() if end > now]:
            self.handle.registerTimer(min(left))  # to forget the window, should the client not come again
        if out:
            yield pd.DataFrame(out, columns=["request_id", "ts", "client", "kind", "accepted", "remaining"])


def _milliseconds(at: str = "ts") -> Column:
    return F.unix_millis(F.col(at))


def decide_stream(requests: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """``decide`` over a stream of requests (request_id, ts, client string, kind, most, seconds), to the millisecond: accept or reject as the watermark passes."""
    rows = requests.withWatermark("ts", watermark).select("client", "kind", "ts", _milliseconds().alias("at"), "request_id", F.col("most").cast("int").alias("most"), F.col("seconds").cast("int").alias("seconds"))
    out = "request_id bigint, ts timestamp, client string, kind string, accepted boolean, remaining int"
    return rows.groupBy("client", "kind").transformWithStateInPandas(_Limiter(), out, "Append", "EventTime")


class _Sessions(_Ordered):
    """Progress of one session; it ends with its completion or when nothing has come for ``idle``."""

    WAITING = "at bigint, kind string, total int"

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("state", "start bigint, last bigint, done int, total int, complete boolean")

    def take(self, key, due: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else None
        ended = []
        for at, kind, total in due:
            if state is not None and at - state[1] > self.idle:
                ended.append(state)
                state = None
            start, _, done, most, complete = state or (at, at, 0, None, False)
            most = total if most is None else most if total is None else max(most, total)
            state = (start, at, done + (kind == "step"), most, complete or kind == "complete")
        if state is not None and now - state[1] > self.idle:
            ended.append(state)
            state = None
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
            self.handle.registerTimer(state[1] + self.idle + 1)
        if ended:
            yield pd.DataFrame(
                [(key[0], pd.Timestamp(s[0], unit="ms"), pd.Timestamp(s[1], unit="ms"), s[2], s[3], min(100.0, 100 * s[2] / s[3]) if s[3] else 0.0, "completed" if s[4] else "expired") for s in ended],
                columns=["session_id", "start", "last", "done", "total", "percent", "status"],
            )


def session_ends(events: DataFrame, idle_seconds: int) -> DataFrame:
    """(session_id, start, last, done, total, percent, status) of the sessions of a batch of events (session_id, ts, kind, total).

    A session ends when its id pauses for more than ``idle_seconds``; it is completed if an event said so, else expired.
    """
    each = Window.partitionBy("session_id").orderBy("ts", "kind", "total")
    gap = _milliseconds() - F.lag(_milliseconds()).over(each) > idle_seconds * 1000
    cut = events.withColumn("_run", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(each.rowsBetween(Window.unboundedPreceding, 0)))
    s = cut.groupBy("session_id", "_run").agg(
        F.min("ts").alias("start"), F.max("ts").alias("last"), F.count_if(F.col("kind") == "step").cast("int").alias("done"), F.max("total").cast("int").alias("total"), F.max(F.col("kind") == "complete").alias("c")
    )
    percent = F.when(F.col("total") > 0, F.least(F.lit(100.0), 100 * F.col("done") / F.col("total"))).otherwise(0.0)
    return s.select("session_id", "start", "last", "done", "total", percent.alias("percent"), F.when(F.col("c"), "completed").otherwise("expired").alias("status"))


def session_ends_stream(events: DataFrame, idle_seconds: int, watermark: str = "10 minutes") -> DataFrame:
    """``session_ends`` over a stream (session_id string): a session is told, and its state goes, once the watermark is ``idle_seconds`` past its last event."""
    rows = events.withWatermark("ts", watermark).select("session_id", "ts", _milliseconds().alias("at"), "kind", F.col("total").cast("int").alias("total"))
    out = "session_id string, start timestamp, last timestamp, done int, total int, percent double, status string"
    return rows.groupBy("session_id").transformWithStateInPandas(_Sessions(idle_seconds * 1000), out, "Append", "EventTime")


def next_job(state: tuple, event: str | None) -> tuple[tuple, bool]:
    """((status, progress, retries, rejected), legal) after an event; an illegal one changes nothing but the count of rejected ones.

    A failed job keeps its progress, may be queued again ``RETRIES`` times, and then starts from nothing.
    """
    status, progress, retries, rejected = state
    legal = event in MOVES.get(status, ()) and not (status == "failed" and retries >= RETRIES)
    if not legal:
        return (status, progress, retries, rejected + 1), False
    return (event, progress if event == "failed" else PROGRESS[event], retries + (status == "failed"), rejected), True


class _Jobs(_Ordered):
    """The state of one job."""

    WAITING = "at bigint, event_id bigint, event string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("state", "status string, progress int, retries int, rejected int")

    def take(self, key, due: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else (None, 0, 0, 0)
        out = []
        for at, event_id, event in due:
            state, legal = next_job(state, event)
            out.append((key[0], event_id, pd.Timestamp(at, unit="ms"), event, legal, *state))
        if out:
            self.state.update(state)
            yield pd.DataFrame(out, columns=["job_id", "event_id", "ts", "event", "legal", "status", "progress", "retries", "rejected"])


JOB_FIELDS = "job_id string, event_id bigint, ts timestamp, event string, legal boolean, status string, progress int, retries int, rejected int"


def job_events_stream(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Every event (job_id string, event_id, ts, event) of a stream with whether it was legal and the job's state after it; late rows within the watermark take their place in time."""
    rows = events.withWatermark("ts", watermark).select("job_id", "ts", _milliseconds().alias("at"), "event_id", "event")
    return rows.groupBy("job_id").transformWithStateInPandas(_Jobs(), JOB_FIELDS, "Append", "EventTime")


def job_events(events: DataFrame) -> DataFrame:
    """``job_events_stream`` of a batch: an ordered fold over each job's events, as one expression (a job's log is one row while it folds)."""
    ordered = events.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event"))).alias("log"))
    moves = F.create_map(*[x for k, v in MOVES.items() for x in (F.lit(k or ""), F.array(*map(F.lit, v)).cast("array<string>"))])
    gained = F.create_map(*[F.lit(x) for kv in PROGRESS.items() for x in kv])
    zero = F.struct(F.lit("").alias("status"), F.lit(0).alias("progress"), F.lit(0).alias("retries"), F.lit(0).alias("rejected"), F.lit(False).alias("legal"))

    def step(s: Column, event: Column) -> Column:
        legal = F.coalesce(F.array_contains(moves[s["status"]], event), F.lit(False)) & ~((s["status"] == "failed") & (s["retries"] >= RETRIES))
        return F.struct(
            F.when(legal, event).otherwise(s["status"]).alias("status"), F.when(legal & (event != "failed"), gained[event]).otherwise(s["progress"]).alias("progress"),
            (s["retries"] + (legal & (s["status"] == "failed")).cast("int")).alias("retries"), (s["rejected"] + (~legal).cast("int")).alias("rejected"), legal.alias("legal"),
        )

    def fold(acc: Column, e: Column) -> Column:
        after = step(acc["s"], e["event"])
        return F.struct(after.alias("s"), F.concat(acc["out"], F.array(F.struct(e.alias("e"), after.alias("s")))).alias("out"))

    kind = "array<struct<e:struct<ts:timestamp,event_id:bigint,event:string>,s:struct<status:string,progress:int,retries:int,rejected:int,legal:boolean>>>"
    folded = ordered.select("job_id", F.explode(F.aggregate("log", F.struct(zero.alias("s"), F.array().cast(kind).alias("out")), fold)["out"]).alias("x"))
    return folded.select("job_id", "x.e.event_id", "x.e.ts", "x.e.event", "x.s.legal", F.nullif(F.col("x.s.status"), F.lit("")).alias("status"), "x.s.progress", "x.s.retries", "x.s.rejected")
