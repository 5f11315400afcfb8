"""Checks of uploaded files and readers of logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as t

# Types of file extensions.
MIME = {
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "doc": "application/msword",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xls": "application/vnd.ms-excel", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "ppt": "application/vnd.ms-powerpoint", "odt": "application/vnd.oasis.opendocument.text", "ods": "application/vnd.oasis.opendocument.spreadsheet", "odp": "application/vnd.oasis.opendocument.presentation",
    "rtf": "application/rtf", "md": "text/markdown", "html": "text/html", "htm": "text/html", "txt": "text/plain", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tiff": "image/tiff",
    "bmp": "image/bmp", "gif": "image/gif", "svg": "image/svg+xml", "csv": "text/csv", "tsv": "text/tab-separated-values", "xml": "application/xml", "json": "application/json", "epub": "application/epub+zip",
}
# Largest size of some types in MB; others 10.
MOST_MB = {
    "pdf": 50, "docx": 20, "doc": 20, "xlsx": 50, "xls": 50, "pptx": 50, "ppt": 50, "odt": 20, "ods": 50, "odp": 50, "rtf": 10, "md": 5, "html": 10, "txt": 5, "png": 20, "jpg": 20, "tiff": 100, "bmp": 50, "gif": 20,
    "svg": 5, "csv": 10, "tsv": 10, "xml": 10, "json": 10, "epub": 100,
}
# First bytes of programs, and those that some types must have (hex).
PROGRAMS = ("4D5A", "7F454C46", "CAFEBABE", "FEEDFA")
HEADERS = {"application/pdf": ("255044462D",), "image/png": ("89504E470D0A1A0A",), "image/jpeg": ("FFD8FF",), "image/tiff": ("49492A00", "4D4D002A"), "image/bmp": ("424D",)}
ZIPPED = ("docx", "xlsx", "pptx", "epub")
TEXTS = ("text/markdown", "text/html", "text/plain", "text/csv", "text/tab-separated-values")
MALWARE = ("powershell.exe -encodedcommand", "cmd.exe /c", "script.exe", "javascript:vbscript")


def lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def mime_type(filename: Column) -> Column:
    """The type of a file name's extension, null for one that is not allowed."""
    return lookup(MIME, F.lower(F.regexp_extract(filename, r"\.([^.]+)$", 1)))


def begins(head: Column, signs: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(head, F.lit(x)) for x in signs])


def malware(content: Column) -> Column:
    """Whether a content (binary or text) holds one of the suspicious substrings, ignoring case."""
    return t.any_of(F.lower(content.cast("string")), list(MALWARE))


def file_problem(content: Column, size: Column, mime: Column) -> Column:
    """The first reason to reject a file, null if there is none.

    ``content`` may be the file's beginning (64 bytes, 1 KB for texts), ``size`` is its whole size in bytes.  Texts must not
    hold a zero byte or more than 7.5 bits of entropy in their first 1024 bytes.
    """
    head, sample = F.hex(F.substring(content, 1, 64)), F.hex(F.substring(content, 1, 1024))
    bytes_ = F.regexp_extract_all(sample, F.lit("(..)"), F.lit(1))
    limit = F.coalesce(lookup({MIME[k]: v << 20 for k, v in MOST_MB.items()}, mime), F.lit(10 << 20))
    wrong = reduce(lambda a, b: a | b, [(mime == k) & ~begins(head, v) for k, v in HEADERS.items()]) | (mime.isin(*[MIME[k] for k in ZIPPED]) & ~begins(head, ("504B",)))
    jpeg_end = (mime == "image/jpeg") & ~F.contains(F.substring(head, -20, 20), F.lit("FFD9"))
    text = mime.isin(*TEXTS)
    bomb = ((mime == "application/pdf") & (size > 40 << 20)) | (F.startswith(mime, F.lit("image/")) & (size > 15 << 20))
    return (
        F.when(size == 0, "empty").when(size < 100, "too_small").when(mime.isNull(), "type").when(begins(head, PROGRAMS), "program").when(wrong | jpeg_end, "header")
        .when(text & F.array_contains(bytes_, "00"), "zero_byte").when(text & (sequence_entropy(bytes_) > 7.5), "entropy").when(bomb, "bomb").when(size > limit, "too_large")
    )


def sequence_entropy(items: Column) -> Column:
    """Shannon entropy in bits of a short array."""
    def bits(x: Column) -> Column:
        counts = F.transform(F.array_distinct(x), lambda v: F.size(F.filter(x, lambda y: y == v)) / F.size(x))
        return F.aggregate(counts, F.lit(0.0).cast("double"), lambda a, p: a - p * F.log2(p))

    return t.let(items, bits)


def performance_log(lines: DataFrame) -> DataFrame:
    """(line, method, seconds, memory) of the log lines (line, value) with at least six fields between `` | ``; unreadable numbers drop the line."""
    f = F.split("value", r" \| ")
    number = lambda i, a, b: F.replace(F.replace(F.get(f, i), F.lit(a), F.lit("")), F.lit(b), F.lit("")).try_cast("double")
    out = lines.where(F.size(f) >= 6).select("line", F.replace(F.get(f, 2), F.lit("Method: "), F.lit("")).alias("method"), number(3, "Time: ", "s").alias("seconds"), number(4, "Memory: ", "MB").alias("memory"))
    return out.where("seconds is not null and memory is not null")


def performance_stats(lines: DataFrame, n: int = 10) -> DataFrame:
    """One row: all lines, how many of the last ``n``, their means over that number, and the methods with counts."""
    last = lines.orderBy(F.desc("line")).limit(n)
    recent = F.greatest(F.lit(1), F.least(F.col("lines"), F.lit(n)))
    total = lines.agg(F.count("*").alias("lines"))
    by_method = performance_log(last).groupBy("method").agg(F.count("*").alias("m"), F.sum("seconds").alias("s"), F.sum("memory").alias("b"))
    sums = by_method.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"), F.coalesce(F.sum("b"), F.lit(0.0)).alias("b"), F.array_sort(F.collect_list(F.struct("method", "m"))).alias("methods"))
    return total.crossJoin(sums).select("lines", F.least("lines", F.lit(n)).alias("recent"), (F.col("s") / recent).alias("mean_seconds"), (F.col("b") / recent).alias("mean_memory"), "methods")  # one row each


def json_log(lines: DataFrame, schema: str) -> DataFrame:
    """Events of a structured log (value: one JSON object a line); broken lines drop out."""
    return lines.select(F.from_json("value", schema).alias("e")).where("e.event_type is not null").select("e.*")


def relevance_ranges(scores: DataFrame, by: str, score: str) -> DataFrame:
    """(by, mean, highest, lowest, n) of relevance scores, rounded to four places (half to even)."""
    return scores.groupBy(by).agg(*[F.bround(f(score), 4).alias(n) for f, n in ((F.avg, "mean"), (F.max, "highest"), (F.min, "lowest"))], F.count("*").alias("n"))


def csv_line(*fields: Column) -> Column:
    """One line of comma-separated values: every field in quotes, quotes doubled, null empty."""
    return F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.coalesce(f.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for f in fields])
