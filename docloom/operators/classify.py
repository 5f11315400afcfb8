"""Document types and structures: headings, hierarchy, pages, keyword classifier, pattern confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import scores
from docloom.functions import text as t


def structure_lines(docs: DataFrame) -> DataFrame:
    """Headings of (doc_id, text): line, level, title, confidence, page (carried on from the last marker)."""
    lines = docs.select("doc_id", F.posexplode(t.lines(F.col("text"))).alias("line", "raw")).select("doc_id", "line", t.strip(F.col("raw")).alias("x"))
    seen = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    paged = lines.withColumn("page", F.last(t.page_marker(F.col("x")), ignorenulls=True).over(seen)).withColumn("level", t.heading_level(F.col("x")))
    heads = paged.where("level is not null").withColumn("title", t.heading_title(F.col("x")))
    return heads.select("doc_id", "line", "level", "title", t.heading_confidence(F.col("title"), F.col("level")).alias("confidence"), "page")


def hierarchy(heads: DataFrame) -> DataFrame:
    """``parent``: the line of the nearest earlier heading of a smaller level (null for roots), level by level."""
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col("level") == k, F.col("line")), ignorenulls=True).over(before) for k in (1, 2)}
    parent = F.when(F.col("level") == 2, last[1]).when(F.col("level") == 3, F.greatest(*last.values()))
    return heads.withColumn("parent", parent)


def structure(docs: DataFrame) -> DataFrame:
    """Per document: type, page_count (markers), roots and confidences (sections, pages, type, overall)."""
    marks = F.size(F.filter(F.transform(F.transform(t.lines(F.col("text")), t.strip), t.page_marker), lambda p: p.isNotNull()))
    base = docs.select("doc_id", scores.structure_type(F.col("text"), F.col("filename")).alias("document_type"), marks.alias("page_count"))
    roots = hierarchy(structure_lines(docs)).where("parent is null").groupBy("doc_id").agg(F.count("*").alias("roots"), F.avg("confidence").alias("mean"))
    out = base.join(roots, "doc_id", "left").withColumn("roots", F.coalesce("roots", F.lit(0)))
    out = out.withColumn("section_confidence", F.coalesce("mean", F.lit(0.1))).drop("mean")
    out = out.withColumn("page_confidence", F.when(F.col("page_count") > 0, F.least(F.col("page_count") / 10, F.lit(1.0))).otherwise(0.1)).withColumn("type_confidence", F.when(F.col("document_type") == "unknown", 0.3).otherwise(0.8))
    return out.withColumn("overall", 0.4 * F.col("section_confidence") + 0.3 * F.col("page_confidence") + 0.3 * F.col("type_confidence"))


def keyword_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, document_type, count, top10, title_score) of whole-word keywords for every type (zeros too)."""
    low, title = F.lower(F.concat_ws(" ", "title", "text")), F.lower(F.coalesce("title", F.lit("")))
    known = sorted({w for ws in scores.TYPES.values() for w in ws})
    hits = docs.select("*", F.filter(F.split(low, r"[^\p{L}\p{N}_]+"), lambda w: w.isin(known)).alias("_hits"))  # one pass over a text for all types
    among = lambda ws: F.size(F.filter("_hits", lambda w: w.isin(ws))) if ws else F.lit(0)
    rows = F.array(*[
        F.struct(F.lit(k).alias("document_type"), among(ws).alias("count"), among(ws[:10]).alias("top10"), F.when(t.any_of(title, ws[:5]), 0.5).otherwise(0.0).alias("title_score") if ws else F.lit(0.0).alias("title_score"))
        for k, ws in scores.TYPES.items()
    ])
    return hits.select("doc_id", F.inline(rows))


def features(chunks: DataFrame) -> DataFrame:
    """Per document of (doc_id, chunk_text, section_title): element counts, hierarchy depth, title variety, formality, sentence length."""
    low = F.lower("chunk_text")
    count = [F.count_if(t.any_of(low, ws)).alias(f"{k}_elements") for k, ws in scores.ELEMENT_WORDS.items()]
    count += [F.count_if(t.any_of(low, ws)).alias(f"{k}_words") for k, ws in scores.PATTERN_WORDS.items()]
    formal, informal = F.sum(scores.word_hits(low, scores.FORMAL)), F.sum(scores.word_hits(low, scores.INFORMAL))
    sentences = F.sum(F.size(F.filter(t.parts(F.col("chunk_text")), lambda s: t.strip(s) != "")))
    return chunks.groupBy("doc_id").agg(
        *count, F.max(F.coalesce(t.section_depth(F.col("section_title")), F.lit(0))).alias("hierarchy_depth"), F.countDistinct("section_title").alias("section_variety"),
        (formal / F.greatest(formal + informal, F.lit(1))).alias("formality"), (F.sum(t.token_count(F.col("chunk_text"))) / F.greatest(sentences, F.lit(1))).alias("sentence_length"),
    )


def pattern_confidence(f: DataFrame) -> DataFrame:
    """(doc_id, pattern, confidence) of structure patterns above 0.3, from ``features``."""
    deep = F.least(F.col("hierarchy_depth") * 0.3 + F.col("section_variety") * 0.1, F.lit(1.0))
    two = {k: F.least(F.col(f"{k}_elements") * F.lit(0.2) + F.col(f"{k}_words") * F.lit(0.1), F.lit(1.0)) for k in ("procedural", "argumentative", "descriptive")}
    one = {k: F.least(F.col(f"{k}_words") * F.lit(0.2), F.lit(1.0)) for k in ("comparative", "narrative")}
    rows = F.array(*[F.struct(F.lit(k).alias("pattern"), c.alias("confidence")) for k, c in ({"section_hierarchy": deep} | two | one).items()])
    return f.select("doc_id", F.inline(rows)).where(F.round("confidence", 9) > 0.3)


def classify(counts: DataFrame, f: DataFrame) -> DataFrame:
    """(doc_id, document_type, confidence, place): .4 keyword share, .3 top keywords, .2 structure, .1 title; ties in the order of types."""
    total = F.sum("count").over(Window.partitionBy("doc_id"))
    parts = {"section_hierarchy": F.col("hierarchy_depth") / 3, **{k: F.col(f"{k}_elements") / 5 for k in ("procedural", "argumentative", "descriptive")}}
    expected = F.create_map(*[x for k, ps in scores.EXPECTED.items() for x in (F.lit(k), F.array(*map(F.lit, ps)).cast("array<string>"))])
    structure = reduce(lambda a, b: a + b, [F.when(F.array_contains(expected[F.col("document_type")], k), F.least(c, F.lit(1.0)) * 0.25).otherwise(0.0) for k, c in parts.items()])
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(scores.TYPES) for x in (k, i)])[F.col("document_type")]
    score = F.least(F.lit(1.0), F.col("count") / F.greatest(total, F.lit(1)) * 0.4 + F.least(F.col("top10") / 10, F.lit(1.0)) * 0.3 + structure * 0.2 + F.col("title_score") * 0.1)
    scored = counts.join(f, "doc_id").withColumn("confidence", score)
    return scored.select("doc_id", "document_type", "confidence", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.round("confidence", 9)), rank)).alias("place"))


def report(scored: DataFrame, status: str, score: str, statuses: list[str]) -> DataFrame:
    """Rows per status over all statuses, with mean score (null without rows)."""
    spark = scored.sparkSession
    dim = spark.createDataFrame([(s,) for s in statuses], f"{status} string")
    return F.broadcast(dim).join(scored.groupBy(status).agg(F.count("*").alias("n"), F.avg(score).alias("mean")), status, "left").select(status, F.coalesce("n", F.lit(0)).alias("n"), "mean")


def suggestion_counts(scored: DataFrame, tips: dict[str, Column], k: int = 5) -> DataFrame:
    """(suggestion, n): the ``k`` suggestions that most rows call for; conditions are counted in one pass."""
    n = scored.agg(*[F.count_if(c).alias(f"t{i}") for i, c in enumerate(tips.values())])
    each = n.select(F.explode(F.array(*[F.struct(F.lit(tip).alias("suggestion"), F.col(f"t{i}").alias("n")) for i, tip in enumerate(tips)])).alias("x")).select("x.*")
    return each.where("n > 0").orderBy(F.desc("n"), "suggestion").limit(k)


def distributions(primary: DataFrame, patterns: DataFrame) -> DataFrame:
    """(dimension, value, n, most_common): how many documents have each type (doc_id, document_type) and each pattern (doc_id, pattern); ties to the smaller name."""
    both = primary.select(F.lit("type").alias("dimension"), F.col("document_type").alias("value")).unionByName(patterns.select(F.lit("pattern").alias("dimension"), F.col("pattern").alias("value")))
    counts = both.groupBy("dimension", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("dimension").orderBy(F.desc("n"), "value")  # a handful of types and patterns
    return counts.withColumn("most_common", F.row_number().over(order) == 1)
