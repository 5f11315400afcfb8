"""Stored tables: merges, caches and ingestion that are stopped half-way."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docloom.operators import tablestore as ts

COUNTS = "query_id bigint, search_count bigint, first_seen timestamp, last_seen timestamp"
EVENTS = "query_id bigint, at timestamp"


def at(day):
    return datetime(2024, 1, day)


def test_merge_rewrites_only_touched_buckets(spark, tmp_path):
    table = ts.KeyedTable(spark, f"file://{tmp_path}/t", COUNTS, ["query_id"], 16)
    assert table.read().count() == 0 and table.version == 0
    ts.upsert_counts(table, spark.createDataFrame([(k, at(1 + k % 9)) for k in range(200)] + [(None, at(1))], EVENTS), "query_id", "at")
    before, files = table.folders(), {p: p.stat().st_mtime_ns for p in tmp_path.rglob("part-*.parquet")}
    ts.upsert_counts(table, spark.createDataFrame([(7, at(3)), (7, at(28)), (7, at(1)), (1000, at(5))], EVENTS), "query_id", "at")
    after = table.folders()
    changed = [b for b in after if before.get(b) != after[b]]
    assert 1 <= len(changed) <= 2 and table.version == 2
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())  # no file was written over
    got = {r["query_id"]: tuple(r)[1:] for r in table.read().collect()}
    assert got[7] == (4, at(1), at(28)) and got[1000] == (1, at(5), at(5)) and len(got) == 201
    table.vacuum(1)
    assert {r["query_id"]: tuple(r)[1:] for r in table.read().collect()} == got
    ts.upsert_counts(table, spark.createDataFrame([], EVENTS), "query_id", "at")
    assert table.read().count() == 201


def test_batches_count_once_and_writers_conflict(spark, tmp_path):
    table = ts.KeyedTable(spark, f"file://{tmp_path}/t", COUNTS, ["query_id"], 4)
    rows = spark.createDataFrame([(1, at(1)), (2, at(2))], EVENTS)
    assert ts.upsert_counts(table, rows, "query_id", "at", "log", 0)
    assert not ts.upsert_counts(table, rows, "query_id", "at", "log", 0)  # sent again
    assert ts.upsert_counts(table, rows, "query_id", "at", "log", 1)
    assert {r["search_count"] for r in table.read().collect()} == {2}
    stale = table._manifest()
    stale["version"] -= 1
    table._manifest = lambda: stale  # a writer that began before the last commit
    with pytest.raises(ts.Conflict):
        ts.upsert_counts(table, rows, "query_id", "at")
    del table._manifest
    assert {r["search_count"] for r in table.read().collect()} == {2}
    for wrong in ([(3, 1, at(1), at(1)), (3, 1, at(1), at(1))], [(None, 1, at(1), at(1))]):
        with pytest.raises(ValueError, match="once"):
            table.merge(spark.createDataFrame(wrong, COUNTS))


def test_cache_computes_only_what_is_due(spark, tmp_path):
    results = ts.cache(spark, f"file://{tmp_path}/c", 8)
    seen = []

    def compute(df):
        rows = df.collect()
        seen.append(sorted(r["content"] for r in rows))
        bad = F.col("content").startswith("bad") & F.lit(len(seen) == 1)
        return df.select("content_hash", F.when(~bad, F.length("content").cast("string")).alias("result"), F.when(bad, "refused").alias("error"))

    docs = lambda *x: spark.createDataFrame([(k, t) for k, t in enumerate(x)], "id long, content string")
    ts.run_due(results, docs("one", "two", "one", None, "bad one", ""), "local/a", compute)
    ts.run_due(results, docs("one", "three", "bad one"), "local/a", compute)  # new contents and failed ones only
    ts.run_due(results, docs("one", "three"), "local/a", compute)
    ts.run_due(results, docs("one", "three"), "local/b", compute)  # other settings: all anew
    assert seen == [["", "bad one", "one", "two"], ["bad one", "three"], [], ["one", "three"]]
    kept = results.read().where("settings = 'local/a'").collect()
    assert len(kept) == 5 and all(r["error"] is None and r["result"] is not None for r in kept)


def files(spark, folder):
    return spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", 2).schema("value string").load(folder).select(F.col("_metadata.file_name").alias("path"), F.col("value").alias("content"))


@pytest.mark.parametrize("when", ["before", "after"])
def test_ingestion_survives_a_death_half_way(spark, tmp_path, when):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(7):
        (folder / f"{k}.txt").write_text(f"text {k}\nof it")
    table = ts.documents(spark, f"file://{tmp_path}/t", 4)
    whole, died = table.merge, []

    def dying(rows, combine, source, batch):
        if batch == 2 and not died and when == "before":
            died.append(batch)
            rows.count()
            raise OSError("lost before the commit")
        done = whole(rows, combine, source, batch)
        if batch == 2 and not died:
            died.append(batch)
            raise OSError("lost after the commit")
        return done

    table.merge = dying
    with pytest.raises(Exception, match="lost"):
        ts.ingest(files(spark, str(folder)), table, f"{tmp_path}/marks").awaitTermination(200)
    ts.ingest(files(spark, str(folder)), table, f"{tmp_path}/marks").awaitTermination(200)
    got = {r["path"]: r["content"] for r in table.read().collect()}
    assert died == [2] and got == {f"{k}.txt": f"text {k}\nof it" for k in range(7)} and table.read().count() == 7
    assert table.version == 4  # four batches of at most two files, none twice
    (folder / "new.txt").write_text("more")
    ts.ingest(files(spark, str(folder)), table, f"{tmp_path}/marks").awaitTermination(200)
    assert table.read().count() == 8
