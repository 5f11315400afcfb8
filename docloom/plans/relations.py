"""Queries of relationships between the sources of the corpus: each source is one document of the set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import relations as rel
from docloom.plans.registry import DOCS, query
from docloom.sources import tables

_ALL = r"(SELECT DISTINCT source AS doc, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents WHERE source IS NOT NULL)"
_TERMS = f"(SELECT * FROM {_ALL} WHERE length(term) > 3)"
_TITLES = r"(SELECT DISTINCT source AS doc, unnest(regexp_extract_all(lower(string_split(text, chr(10))[1]), '[\p{L}\p{N}_]+')) AS term FROM documents WHERE source IS NOT NULL)"


def _overlap(terms: str) -> str:
    return f"""(SELECT a, b, common, common / (x.n + y.n - common) AS score FROM (SELECT p.doc AS a, q.doc AS b, count(*) AS common FROM {terms} p JOIN {terms} q USING (term) WHERE p.doc < q.doc GROUP BY 1, 2) t
  JOIN (SELECT doc, count(*) AS n FROM {terms} GROUP BY 1) x ON x.doc = a JOIN (SELECT doc, count(*) AS n FROM {terms} GROUP BY 1) y ON y.doc = b)"""


_STATS = "(SELECT source AS doc, avg(n_chars) AS mean_size, list_distinct(list(lang)) AS titles FROM documents WHERE source IS NOT NULL GROUP BY 1)"
_STRUCTURE = f"""(SELECT x.doc AS a, y.doc AS b, (1 - abs(x.mean_size - y.mean_size) / greatest(x.mean_size, y.mean_size) + len(list_intersect(x.titles, y.titles)) / greatest(len(x.titles), len(y.titles))) / 2 AS score
  FROM {_STATS} x JOIN {_STATS} y ON x.doc < y.doc)"""


#: What makes one document of the set: its source, or its language and half of the corpus.
SOURCE, HALF = "source", "lang || '-' || (doc_id % 2)"


def terms(spark: SparkSession, sf: str, longer_than: int = 0, doc: str = SOURCE) -> DataFrame:
    """Distinct (doc, term) of the set, of whole texts."""
    text = F.lower("text")
    d = tables.table(spark, sf, "documents").where(f"({doc}) is not null")
    each = d.select(F.expr(doc).alias("doc"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))).alias("term"))
    return each.where(F.length("term") > longer_than).distinct()


def title_terms(spark: SparkSession, sf: str, doc: str = SOURCE) -> DataFrame:
    """Distinct (doc, term) of the set, of the texts' whole first lines."""
    d = tables.table(spark, sf, "documents").where(f"({doc}) is not null")
    title = F.lower(F.substring_index("text", "\n", 1))
    return d.select(F.expr(doc).alias("doc"), F.explode(F.array_distinct(F.regexp_extract_all(title, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))).alias("term")).distinct()


def stats(spark: SparkSession, sf: str, doc: str = SOURCE) -> DataFrame:
    d = tables.table(spark, sf, "documents").where(f"({doc}) is not null")
    return d.groupBy(F.expr(doc).alias("doc")).agg(F.avg("n_chars").alias("mean_size"), F.collect_set("lang").alias("titles"))


@query(f"SELECT a, b, common, round(score, 6) AS score FROM {_overlap(_TITLES)}")
def jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rel.overlaps(title_terms(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"SELECT a, b, round(score, 6) AS score FROM {_STRUCTURE}")
def structural_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return rel.structural(stats(spark, sf)).withColumn("score", F.round("score", 6))


_RELATED = f"""(SELECT a, b, CASE WHEN c > 0.7 THEN 'similar' WHEN t > 0.7 AND c < 0.3 THEN 'conflicting' WHEN t > 0.5 AND c < 0.3 THEN 'complementary' WHEN s > 0.6 THEN 'referential' ELSE 'similar' END AS kind, (c + t + s) / 3 AS confidence
  FROM (SELECT z.a, z.b, coalesce(x.score, 0) AS c, coalesce(y.score, 0) AS t, z.score AS s FROM {_STRUCTURE} z LEFT JOIN {_overlap(_TERMS)} x USING (a, b) LEFT JOIN {_overlap(_TITLES)} y USING (a, b)))"""


def _related(spark: SparkSession, sf: str, doc: str = SOURCE) -> DataFrame:
    content, topic = (rel.overlaps(x).select("a", "b", F.col("score").alias(n)) for x, n in ((terms(spark, sf, 3, doc), "content"), (title_terms(spark, sf, doc), "topic")))
    pairs = rel.structural(stats(spark, sf, doc)).withColumnRenamed("score", "structure").join(content, ["a", "b"], "left").join(topic, ["a", "b"], "left")
    return rel.relationships(pairs.fillna(0.0, ["content", "topic"]))


@query(f"SELECT a, b, kind, round(confidence, 6) AS confidence FROM {_RELATED} WHERE confidence >= 0.3")
def relationship_types(spark: SparkSession, sf: str) -> DataFrame:
    return _related(spark, sf).withColumn("confidence", F.round("confidence", 6))


@query(f"SELECT a, b, round(confidence, 6) AS confidence FROM {_RELATED.replace('source', f'({HALF})')} WHERE confidence > 0.5")
def relationship_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between the halves of the corpus's languages."""
    return _related(spark, sf, HALF).where("confidence > 0.5").select("a", "b", F.round("confidence", 6).alias("confidence"))


@query(f"""SELECT term, count(*) AS docs, CASE WHEN count(*) > 2 THEN 'high' ELSE 'medium' END AS importance, CASE WHEN count(*) > 3 THEN 'comprehensive' ELSE 'partial' END AS coverage
  FROM {_TERMS} GROUP BY term ORDER BY docs DESC, term LIMIT 20""")
def topic_df_top20(spark: SparkSession, sf: str) -> DataFrame:
    return rel.topic_frequencies(terms(spark, sf, 3))


@query(f"""SELECT count(*) FILTER (n > 2) AS deep, count(*) FILTER (n = 2) AS moderate, count(*) FILTER (n = 1) AS shallow, round(count(*) FILTER (n > 1) / count(*), 6) AS score FROM (SELECT term, count(*) AS n FROM {_TERMS} GROUP BY term)""")
def coverage_depth(spark: SparkSession, sf: str) -> DataFrame:
    return rel.coverage_depth(terms(spark, sf, 3)).withColumn("score", F.round("score", 6))


@query(f"SELECT lang AS doc, source AS term FROM (SELECT DISTINCT lang FROM documents), (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) EXCEPT SELECT lang, source FROM documents WHERE n_chars > 1000")
def topic_gap(spark: SparkSession, sf: str) -> DataFrame:
    d = tables.table(spark, sf, "documents")
    expected = d.select(F.col("lang").alias("doc")).distinct().crossJoin(d.where("source is not null").select(F.col("source").alias("term")).distinct())  # languages by sources
    return rel.gaps(expected, d.where("n_chars > 1000").select(F.col("lang").alias("doc"), F.col("source").alias("term")))


@query(f"""SELECT id, user_id, row_number() OVER w AS place, lag(filename) OVER w AS before, CASE WHEN row_number() OVER w = 1 THEN 'first' WHEN row_number() OVER w = count(*) OVER (PARTITION BY user_id) THEN 'last' END AS milestone
  FROM {DOCS} WINDOW w AS (PARTITION BY user_id ORDER BY created_at, filename)""")
def timeline(spark: SparkSession, sf: str) -> DataFrame:
    return rel.timeline(tables.documents(spark, sf), "user_id", "created_at", "filename").select("id", "user_id", "place", "before", "milestone")
