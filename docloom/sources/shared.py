"""Folders that every executor reads, and small marks of what they hold."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; only a local master may go without and gets a folder of its own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = f"file://{tempfile.mkdtemp(prefix='docloom-')}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


class Store:
    """A folder in any file system that Spark reads: existence, small texts, renames, removal."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def names(self, name: str = "") -> list[str]:
        """Sorted names directly below a folder of the store; none if it is absent."""
        if not self._fs.exists(self._path(self.at(name))):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.at(name))))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a small text at once, under a name that must be new; False if it is there already."""
        draft = self._path(self.at(f"_draft-{hashlib.sha256((name + text).encode()).hexdigest()[:16]}"))
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if self.exists(name) or not self._fs.rename(draft, self._path(self.at(name))):
            self._fs.delete(draft, False)
            return False
        return True

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name)), True)

    def keep_until_exit(self) -> None:
        """Removes the whole folder when the JVM ends."""
        self._fs.deleteOnExit(self._path(self.path))


class Scratch(Store):
    """A store of its own below the shared folder, gone when the JVM ends: tables written to cut lineage."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        super().__init__(spark, f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}")
        self.keep_until_exit()

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.at(name))
        return self.spark.read.schema(df.schema).parquet(self.at(name))
