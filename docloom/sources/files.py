"""Folders of text files as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import checks


def text_files(spark: SparkSession, path: str, glob: str = "*.{md,txt,html,htm,csv,tsv,json,xml}") -> DataFrame:
    """(path, filename, mime_type, file_size, content, content_hash) of the files below a folder whose name fits ``glob`` and whose extension is allowed.

    Contents are UTF-8 with plain line ends; an empty file gives no row (Spark reads none of it).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path", name.alias("filename"), checks.mime_type(name).alias("mime_type"), F.col("length").alias("file_size"),
        F.replace(F.decode("content", "UTF-8"), F.lit("\r\n"), F.lit("\n")).alias("content"), F.md5("content").alias("content_hash"),
    ).where(F.col("mime_type").isNotNull())
