"""Queries of multi-document analysis: the corpus's sources are the documents of the set, a source's first text is its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import multidoc as md
from docloom.operators import relations as rel
from docloom.plans.registry import DOCS, query
from docloom.plans.relations import _RELATED, _TERMS, _related, terms
from docloom.plans.retrieval import STRIP, WORDS
from docloom.sources import tables

_SET = "(SELECT source AS doc, source || ' papers' AS title, min_by(text, doc_id) AS summary, count(*) AS chunks, count(DISTINCT lang) AS sections FROM documents WHERE source IS NOT NULL GROUP BY source)"
_FOUND = f"(SELECT a, b, kind, confidence FROM {_RELATED} WHERE confidence >= 0.3)"
_LOW = "lower(coalesce({c}, ''))"
_OVERLAP_WORDS = f"list_distinct(list_concat({WORDS.format(c=_LOW.format(c='title'))}, {WORDS.format(c=_LOW.format(c='summary'))}[1:20]))"
_OVERLAP = f"(SELECT x.doc AS a, y.doc AS b, CASE WHEN len(x.w) > 0 AND len(y.w) > 0 THEN len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) ELSE 0 END AS overlap FROM (SELECT doc, {_OVERLAP_WORDS} AS w FROM {_SET}) x JOIN (SELECT doc, {_OVERLAP_WORDS} AS w FROM {_SET}) y ON x.doc < y.doc)"
_STRUCT = f"""(SELECT a, b, c, s, (c + s) / 2 AS similarity FROM (SELECT x.doc AS a, y.doc AS b, 1 - abs(x.chunks - y.chunks) / greatest(x.chunks, y.chunks, 1) AS c, 1 - abs(x.sections - y.sections) / greatest(x.sections, y.sections, 1) AS s FROM {_SET} x JOIN {_SET} y ON x.doc < y.doc))"""


def documents(spark: SparkSession, sf: str) -> DataFrame:
    d = tables.table(spark, sf, "documents").where("source is not null")
    return d.groupBy(F.col("source").alias("doc")).agg(F.concat(F.first("source"), F.lit(" papers")).alias("title"), F.min_by("text", "doc_id").alias("summary"), F.count("*").alias("chunks"), F.countDistinct("lang").alias("sections"))


@query(f"SELECT a, b, round(overlap, 6) AS overlap FROM {_OVERLAP}")
def content_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return md.content_overlap(documents(spark, sf)).withColumn("overlap", F.round("overlap", 6))


@query(f"SELECT a, b, round(c, 6) AS chunk_similarity, round(s, 6) AS section_similarity, round(similarity, 6) AS similarity FROM {_STRUCT}")
def structure_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return md.structure_comparison(documents(spark, sf)).select("a", "b", *[F.round(c, 6).alias(c) for c in ("chunk_similarity", "section_similarity", "similarity")])


@query(f"""SELECT a, b, round(coalesce(confidence, 0), 6) AS similarity, coalesce(kind, 'unrelated') AS kind, round(overlap, 6) AS overlap, round(s.similarity, 6) AS structure,
  CASE WHEN coalesce(confidence, 0) < 0.3 THEN 'key_difference' WHEN confidence > 0.7 THEN 'key_similarity' END AS finding FROM {_OVERLAP} o LEFT JOIN {_FOUND} f USING (a, b) JOIN {_STRUCT} s USING (a, b)""")
def comparative_analysis(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    out = md.comparative(_related(spark, sf), md.content_overlap(d), md.structure_comparison(d))
    return out.select("a", "b", *[F.round(c, 6).alias(c) for c in ("similarity", "overlap", "structure")], "kind", "finding")


_BOTH = f"(SELECT a AS doc, b AS other, kind, confidence FROM {_FOUND} UNION ALL SELECT b, a, kind, confidence FROM {_FOUND})"


@query(f"SELECT * FROM (SELECT doc, other, kind, round(confidence, 6) AS confidence, CAST(row_number() OVER (PARTITION BY doc ORDER BY round(confidence, 9) DESC, other) AS INT) AS rank FROM {_BOTH}) WHERE rank <= 10")
def related_documents(spark: SparkSession, sf: str) -> DataFrame:
    return md.relatives(_related(spark, sf)).withColumn("confidence", F.round("confidence", 6))


@query(f"SELECT doc, count(*) AS total, {', '.join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ('similar', 'complementary', 'conflicting', 'referential'))} FROM {_BOTH} GROUP BY doc")
def relationship_counts(spark: SparkSession, sf: str) -> DataFrame:
    return md.relationship_counts(_related(spark, sf))


@query(f"""SELECT doc, CASE WHEN len(c) > 0 THEN c ELSE ['Document: ' || title] END AS contributions FROM (SELECT doc, title, list_filter(list_transform(string_split(summary, '.')[1:3], lambda x: {STRIP.format(c='x')}), lambda x: x <> '') AS c FROM {_SET})""")
def key_contributions(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc", md.contributions(F.col("title"), F.col("summary")).alias("contributions"))


@query(f"SELECT string_agg(summary, ' ' ORDER BY doc)[1:500] AS summary FROM {_SET} WHERE length(summary) > 0")
def unified_summary(spark: SparkSession, sf: str) -> DataFrame:
    return md.unified_summary(documents(spark, sf))


@query(f"""WITH b AS (SELECT count(*) FILTER (n > 1) AS broad FROM (SELECT term, count(*) AS n FROM {_TERMS} GROUP BY term ORDER BY n DESC, term LIMIT 20)), e AS (SELECT count(*) AS edges FROM {_FOUND} WHERE confidence > 0.5), d AS (SELECT count(*) AS n FROM {_SET})
  SELECT 'breadth' AS gap, 'medium' AS severity FROM b WHERE broad < 5 UNION ALL SELECT 'connectivity', 'low' FROM e, d WHERE edges < n - 1""")
def knowledge_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return md.knowledge_gaps(rel.topic_frequencies(terms(spark, sf, 3)), _related(spark, sf), documents(spark, sf).count())


@query(f"SELECT id, filename, false AS missing FROM {DOCS} WHERE id IN (3, 1, 4, 15, 92) UNION ALL SELECT 100000000007, NULL, true")
def documents_by_id(spark: SparkSession, sf: str) -> DataFrame:
    found, missing = md.selected(tables.documents(spark, sf), [3, 1, 4, 15, 92, 100_000_000_007])
    lost = spark.createDataFrame([(i,) for i in missing], "id long").select("id", F.lit(None).cast("string").alias("filename"), F.lit(True).alias("missing"))
    return found.select("id", "filename", F.lit(False).alias("missing")).unionByName(lost)
