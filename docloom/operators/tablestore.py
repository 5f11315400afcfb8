"""Stored tables that merge: keyed rows in hash buckets, swapped by manifests; result caches and stream ingestion over them.

A table is a folder of Parquet data and of numbered manifests.  A manifest names, for every bucket, the folder that holds it
now.  A merge rewrites only the buckets that its keys fall into, beside the old ones, and then creates the next manifest in one
rename: readers see the old table or the new one, a run that dies before that leaves no trace in it, and of two
writers one is refused.  The manifest also remembers the last batch of each source, so a batch that is sent
again changes nothing.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docloom.sources.shared import Store

#: Takes an old value (null without an old row) and a new one and gives the one to keep; rows that nothing new comes for stay as they are.
Combine = Callable[[Column, Column], Column]


def latest(old: Column, new: Column) -> Column:
    """The new value, else the old one."""
    return F.coalesce(new, old)


def replaced(old: Column, new: Column) -> Column:
    """The new value, null or not."""
    return new


def added(old: Column, new: Column) -> Column:
    return F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


class KeyedTable:
    """A stored table with one row per key.

    ``schema`` and ``keys`` say its columns; key columns may not be null (rows with a null key are refused by an error).
    The number of buckets is fixed when the table is first written.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64) -> None:
        self.spark, self.store, self.keys, self.buckets = spark, Store(spark, path), keys, buckets
        self.schema = T.StructType.fromDDL(schema)
        if "_bucket" in self.schema.names:
            raise ValueError("_bucket is a name of the table's own")

    def _manifest(self) -> dict:
        found = sorted(int(m[1]) for n in self.store.names("manifests") if (m := re.fullmatch(r"(\d+)\.json", n)))
        return json.loads(self.store.read(f"manifests/{found[-1]}.json")) if found else {"version": 0, "buckets": self.buckets, "folders": {}, "applied": {}}

    @property
    def version(self) -> int:
        return self._manifest()["version"]

    def folders(self) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        return {int(k): v for k, v in self._manifest()["folders"].items()}

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(self.store.at(f) for f in folders))

    def read(self) -> DataFrame:
        return self._read(list(self._manifest()["folders"].values()))

    def merge(self, rows: DataFrame, combine: dict[str, Combine] | None = None, source: str | None = None, batch: int | None = None) -> bool:
        """Merges rows with one row per key into the table; False if the source's batch is there already.

        ``combine`` says how a column's old and new value meet (default: ``latest``).  Two rows of the same key in ``rows`` are an error.
        """
        now = self._manifest()
        if source is not None and batch is not None and now["applied"].get(source, -1) >= batch:
            return False
        buckets = now["buckets"]
        new = rows.select(*self.schema.names).withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int"))
        told = new.groupBy("_bucket").agg(F.count("*").alias("n"), F.count_distinct(*self.keys).alias("keys")).collect()  # at most ``buckets`` rows
        if any(r["n"] != r["keys"] for r in told):
            raise ValueError("keys must be given once and not be null")
        touched = {r["_bucket"] for r in told}
        folders = {int(k): v for k, v in now["folders"].items()}
        if touched:
            old = self._read([folders[b] for b in sorted(touched & folders.keys())])
            rest = [f.name for f in self.schema if f.name not in self.keys]
            came = new.select(*self.keys, F.lit(True).alias("_came"), *(F.col(c).alias(f"_new_{c}") for c in rest))
            met, ways = old.join(came, self.keys, "full_outer"), combine or {}
            one = lambda c: F.when(F.col("_came"), ways.get(c, latest)(F.col(c), F.col(f"_new_{c}"))).otherwise(F.col(c))
            kept = met.select(*self.keys, *(one(c).cast(self.schema[c].dataType).alias(c) for c in rest))
            folder = f"data/{now['version'] + 1}-{uuid.uuid4().hex}"
            out = kept.select(*self.schema.names, F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int").alias("_bucket"))
            # adaptive execution splits what a bucket has too much of, so a few buckets are not a few tasks
            out.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(self.store.at(folder))
            folders |= {b: f"{folder}/_bucket={b}" for b in touched}
        applied = now["applied"] | ({source: batch} if source is not None and batch is not None else {})
        manifest = {"version": now["version"] + 1, "buckets": buckets, "folders": {str(k): v for k, v in folders.items()}, "applied": applied}
        self.store.create("manifests/.keep", "")
        if not self.store.create(f"manifests/{manifest['version']}.json", json.dumps(manifest)):
            raise Conflict(f"version {manifest['version']} is taken")
        return True

    def vacuum(self, keep: int = 2) -> None:
        """Removes data that none of the last ``keep`` manifests names, and older manifests; not while a merge runs."""
        found = sorted(int(m[1]) for n in self.store.names("manifests") if (m := re.fullmatch(r"(\d+)\.json", n)))
        named = {f.split("/")[1] for v in found[-keep:] for f in json.loads(self.store.read(f"manifests/{v}.json"))["folders"].values()}
        for name in self.store.names("data"):
            if name not in named:
                self.store.remove(f"data/{name}")
        for v in found[:-keep]:
            self.store.remove(f"manifests/{v}.json")


def upsert_counts(table: KeyedTable, events: DataFrame, key: str, at: str, source: str | None = None, batch: int | None = None) -> bool:
    """Adds a batch of events to a stored (key, search_count, first_seen, last_seen)."""
    counts = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("search_count"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))
    return table.merge(counts, {"search_count": added, "first_seen": F.least, "last_seen": F.greatest}, source, batch)


CACHE = "content_hash string, settings string, result string, error string"


def cache(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    """A table of results by content hash and settings (provider, model, version: any text)."""
    return KeyedTable(spark, path, CACHE, ["content_hash", "settings"], buckets)


def due(results: KeyedTable, inputs: DataFrame, settings: str, content: str = "content") -> DataFrame:
    """(content_hash, content) of the distinct contents that have no result under these settings; failed ones are due again, nulls never."""
    told = inputs.where(F.col(content).isNotNull()).groupBy(F.sha2(content, 256).alias("content_hash")).agg(F.first(content).alias("content"))
    done = results.read().where((F.col("settings") == settings) & F.col("error").isNull()).select("content_hash")
    return told.join(done, "content_hash", "left_anti")


def run_due(results: KeyedTable, inputs: DataFrame, settings: str, compute: Callable[[DataFrame], DataFrame], content: str = "content") -> None:
    """Computes what is due and stores it in one merge.

    ``compute`` turns (content_hash, content) into (content_hash, result, error); rows that it leaves out, or that carry an error, stay due.
    A run that dies stores nothing and is simply started again; to store on the way, hand over parts of the inputs.
    """
    made = compute(due(results, inputs, settings, content)).select("content_hash", F.lit(settings).alias("settings"), "result", "error")
    results.merge(made, {"result": replaced, "error": replaced})


DOCUMENTS = "path string, content string, content_hash string, bytes bigint, batch bigint"


def documents(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    """A table of ingested documents by path."""
    return KeyedTable(spark, path, DOCUMENTS, ["path"], buckets)


def ingest(stream: DataFrame, table: KeyedTable, checkpoint: str, source: str = "files", available_now: bool = True) -> StreamingQuery:
    """Merges a stream of (path, content) into ``table``, each batch once however often it is tried.

    The stream's checkpoint says which batch comes next, the manifest which batch is in: a batch that died before its
    manifest is merged whole at the next start, one that died after it is skipped.  A path that comes again replaces its document; within a
    batch its largest content hash counts.  Null paths are left out.
    """

    def each(rows: DataFrame, batch: int) -> None:
        told = rows.where(F.col("path").isNotNull()).select("path", "content", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash"))
        one = told.groupBy("path").agg(F.max_by("content", "content_hash").alias("content"), F.max("content_hash").alias("content_hash"))
        whole = one.withColumn("bytes", F.octet_length(F.coalesce("content", F.lit("")))).withColumn("batch", F.lit(batch))
        table.merge(whole, dict.fromkeys(("content", "content_hash", "bytes", "batch"), replaced), source, batch)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
