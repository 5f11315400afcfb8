"""Stateful streams against their batch forms, with shuffled, late and restarted input."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docloom.streaming import stateful

START = datetime(2024, 1, 10)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset(name)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def stream(spark, tmp_path, batches, schema, made, stop_after=None):
    """The rows of ``made(stream)`` where each of ``batches`` is one micro-batch; with ``stop_after`` the query is stopped there and started again."""
    source, sink, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def go():
        read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        q = made(read).writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks).trigger(availableNow=True).start()
        try:
            q.awaitTermination(300)
            assert not q.isActive
        finally:
            q.stop()

    cut = len(batches) if stop_after is None else stop_after
    for rows in batches[:cut]:
        add(rows)
    go()
    for rows in batches[cut:]:
        add(rows)
    if cut < len(batches):
        go()
    return spark.read.parquet(sink).collect()


REQUESTS = "request_id long, ts timestamp, client string, kind string, role string"


def requests():
    """Two clients, two kinds, roles; some at the same moment."""
    out = []
    for k in range(240):
        role = ("basic", "premium", "guest")[k % 2 + (k % 40 == 0)]
        out.append((k, START + timedelta(seconds=(k * 37) % 9000 // 5 * 5), f"c{k % 2}", ("chat", "api")[k % 3 == 0], role))
    return out


def test_stream_of_decisions_equals_the_batch(rocks, tmp_path):
    limits = {"basic": (5, 1800), "premium": (9, 3600)}
    add = lambda df: stateful.limited(df, "role", limits)
    rows = requests()
    # out of order within a bound: batches of shuffled rows, and two rows at the end that move the watermark on
    rows.sort(key=lambda r: (r[1] - START).seconds + r[0] * 7919 % 600)
    batches = [rows[k : k + 48] for k in range(0, len(rows), 48)] + [[(900, START + timedelta(days=1), "c9", "api", "basic")], [(901, START + timedelta(days=2), "c9", "api", "basic")]]
    want = {r["request_id"]: (r["accepted"], r["remaining"]) for r in stateful.decide(add(rocks.createDataFrame(rows, REQUESTS))).collect()}
    got = stream(rocks, tmp_path, batches, REQUESTS, lambda s: stateful.decide_stream(add(s), "15 minutes"), stop_after=3)
    seen = {r["request_id"]: (r["accepted"], r["remaining"]) for r in got if r["request_id"] < 900}
    assert seen == want and len(seen) == len([r for r in got if r["request_id"] < 900])  # restarted half-way: none twice, none lost
    assert {a for a, _ in want.values()} == {True, False}


EVENTS = "session_id string, ts timestamp, kind string, total int"


def test_sessions_expire_and_late_rows_count(rocks, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    rows = [("a", at(0), "start", 4), ("a", at(5), "step", None), ("b", at(6), "start", 2), ("b", at(8), "step", None), ("b", at(9), "complete", None), ("a", at(70), "start", 3), ("a", at(71), "step", None), ("c", at(72), "step", None)]
    batches = [[rows[0], rows[2]], [rows[3], rows[1], rows[4]], rows[5:], [("z", at(600), "start", None)], [("z", at(1200), "start", None)]]
    want = {tuple(r) for r in stateful.session_ends(rocks.createDataFrame(rows, EVENTS), 1800).collect()}
    got = stream(rocks, tmp_path, batches, EVENTS, lambda s: stateful.session_ends_stream(s, 1800, "10 minutes"), stop_after=2)
    seen = {tuple(r) for r in got if r["session_id"] != "z"}
    assert seen == want and len(want) == 4
    assert {(r[0], r[6]) for r in want} == {("a", "expired"), ("b", "completed"), ("c", "expired")}


JOBS = "job_id string, event_id long, ts timestamp, event string"


def test_jobs_obey_their_moves(rocks, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    steps = ["queued", "processing", "extracted", "completed", "chunked", "completed", "queued"]
    rows = [("j", k, at(k), e) for k, e in enumerate(steps)]
    again = ["queued", "failed", "queued", "failed", "queued", "failed", "queued", "failed", "queued", None]
    rows += [("f", 100 + k, at(k), e) for k, e in enumerate(again)]
    batch = {r["event_id"]: tuple(r)[4:] for r in stateful.job_events(rocks.createDataFrame(rows, JOBS)).collect()}
    assert batch[3] == (False, "extracted", 40, 0, 1) and batch[6] == (False, "completed", 100, 0, 2)
    assert batch[106] == (True, "queued", 0, 3, 0) and batch[108] == (False, "failed", 0, 3, 1) and batch[109] == (False, "failed", 0, 3, 2)
    mixed = sorted(rows, key=lambda r: (r[1] * 7) % 5 + (r[2] - START).seconds // 60)
    batches = [mixed[:6], mixed[6:12], mixed[12:], [("z", 900, at(600), "queued")], [("z", 901, at(1200), "queued")]]
    got = stream(rocks, tmp_path, batches, JOBS, lambda s: stateful.job_events_stream(s, "30 minutes"))
    assert {r["event_id"]: tuple(r)[4:] for r in got if r["event_id"] < 900} == batch


def test_unknown_kinds_and_roles(spark):
    df = spark.createDataFrame([("upload", "admin"), ("what", "x"), (None, None)], "kind string, role string")
    assert [tuple(r)[2:] for r in stateful.limited(df).collect()] == [(10, 3600), (1000, 3600), (1000, 3600)]
    assert [tuple(r)[2:] for r in stateful.limited(df, "role").collect()] == [(5000, 3600), (100, 3600), (100, 3600)]
    empty = stateful.limited(spark.createDataFrame([], REQUESTS))
    assert stateful.decide(empty).count() == 0 and stateful.session_ends(spark.createDataFrame([], EVENTS), 60).count() == 0
    assert stateful.job_events(spark.createDataFrame([], JOBS)).select(F.col("status")).count() == 0
