"""Spark helpers shared by the operators: shared work folders, written intermediate tables, Arrow row maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent on a single machine (local master, as in tests) a local folder is chosen and kept
    in the session; a cluster without the setting is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = f"file://{tempfile.mkdtemp(prefix='docloom-')}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


class Workspace:
    """Written intermediate tables of one operator call, below the shared folder.

    A written table cuts the lineage, so a lost executor costs the tasks that read the table and nothing before
    it.  ``drop`` removes tables that nothing reads any more; what is left goes when the JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path(self.root))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.root}/{name}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def write_bytes(self, data: bytes, name: str) -> str:
        """Writes a small file and returns its path."""
        at = self._path(f"{self.root}/{name}")
        out = self._fs.create(at)
        try:
            for k in range(0, len(data), 1 << 22):
                out.write(bytearray(data[k : k + (1 << 22)]))
        finally:
            out.close()
        return at.toString()

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)


def map_batches(
    df: DataFrame, fields: Iterable[T.StructField], each: Callable[[pa.RecordBatch], Iterator[dict[str, pa.Array]]]
) -> DataFrame:
    """``mapInArrow`` where ``each`` turns a batch into dicts of equally long columns."""
    schema = T.StructType(list(fields))
    arrow = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for out in each(batch):
                    cols = [c if isinstance(c := out[f.name], pa.Array) else pa.array(c, f.type) for f in arrow]
                    yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def filter_batches(df: DataFrame, mask: Callable[[pa.RecordBatch], Iterable[bool]]) -> DataFrame:
    """The rows of ``df``, all columns, for which ``mask`` of their batch holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(mask(batch), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name in df.columns:
        name += "_"
    return name


def hinted(ids: DataFrame, limit: int = 500_000) -> DataFrame:
    """A written table of a few short columns with a broadcast hint if it has at most ``limit`` rows (some 40 MB); beyond, joins shuffle."""
    return F.broadcast(ids) if ids.count() <= limit else ids


def _arrow(t: T.DataType) -> pa.DataType:
    simple = {
        T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.ShortType: pa.int16(), T.ByteType: pa.int8(), T.DoubleType: pa.float64(),
        T.FloatType: pa.float32(), T.BooleanType: pa.bool_(), T.StringType: pa.string(), T.BinaryType: pa.binary(), T.DateType: pa.date32(),
    }
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow(t.elementType))
    if isinstance(t, T.StructType):
        return pa.struct([pa.field(f.name, _arrow(f.dataType)) for f in t])
    if type(t) not in simple:
        raise TypeError(f"ids of type {t.simpleString()} are not supported")
    return simple[type(t)]


def field(df: DataFrame, name: str) -> T.StructField:
    """A nullable copy of a column's field."""
    return T.StructField(name, df.schema[name].dataType, True)


def long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType(), True)


def double(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType(), True)


def string(name: str) -> T.StructField:
    return T.StructField(name, T.StringType(), True)


def boolean(name: str) -> T.StructField:
    return T.StructField(name, T.BooleanType(), True)


def integer(name: str) -> T.StructField:
    return T.StructField(name, T.IntegerType(), True)


def binary(name: str) -> T.StructField:
    return T.StructField(name, T.BinaryType(), True)


def longs(name: str) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.LongType()), True)
