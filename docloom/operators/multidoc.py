"""Analysis of a bounded set of documents: comparison, relatives of one document, synthesis, gaps.

A document of the set is a row (doc, title, summary); ``relations.bounded`` checks that the set is small enough for its pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as t
from docloom.operators.relations import MOST, bounded


def selected(documents: DataFrame, ids: list[int], key: str = "id") -> tuple[DataFrame, list[int]]:
    """The documents of an id list, and the ids without a document (both empty for an empty list)."""
    found = documents.where(F.col(key).isin(*ids)) if ids else documents.limit(0)
    have = {r[0] for r in found.select(key).distinct().collect()}  # at most as many as were named
    return found, sorted(set(ids) - have)


def pairs(documents: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b) with all columns of both (suffixes _a, _b), a < b, of at most ``most`` documents."""
    known = bounded(documents, most)
    a, b = (known.select(*[F.col(c).alias(f"{c}_{s}") for c in documents.columns]) for s in "ab")
    return a.join(F.broadcast(b), F.col("doc_a") < F.col("doc_b")).withColumnRenamed("doc_a", "a").withColumnRenamed("doc_b", "b")


def overlap_words(title: Column, summary: Column, n: int = 20) -> Column:
    """Distinct lower-case words of a title and of the first ``n`` words of a summary."""
    return F.array_distinct(F.concat(t.words(F.lower(F.coalesce(title, F.lit("")))), F.slice(t.words(F.lower(F.coalesce(summary, F.lit("")))), 1, n)))


def content_overlap(documents: DataFrame) -> DataFrame:
    """(a, b, overlap): Jaccard of ``overlap_words``; 0 where a document has none."""
    met = pairs(documents.select("doc", overlap_words(F.col("title"), F.col("summary")).alias("w")))
    both, all_ = F.size(F.array_intersect("w_a", "w_b")), F.size(F.array_union("w_a", "w_b"))
    return met.select("a", "b", F.when((F.size("w_a") > 0) & (F.size("w_b") > 0), both / all_).otherwise(0.0).alias("overlap"))


def structure_comparison(stats: DataFrame) -> DataFrame:
    """(a, b, chunk_similarity, section_similarity, similarity) from (doc, chunks, sections)."""
    near = lambda c: 1 - F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) / F.greatest(f"{c}_a", f"{c}_b", F.lit(1))
    return pairs(stats.select("doc", "chunks", "sections")).select("a", "b", near("chunks").alias("chunk_similarity"), near("sections").alias("section_similarity"), ((near("chunks") + near("sections")) / 2).alias("similarity"))


def comparative(related: DataFrame, overlap: DataFrame, structure: DataFrame) -> DataFrame:
    """One row per pair: similarity (confidence of its relationship, 0 without one), kind, overlap, structure and finding (difference below .3, similarity above .7)."""
    out = overlap.join(related, ["a", "b"], "left").join(structure.select("a", "b", F.col("similarity").alias("structure")), ["a", "b"])
    s = F.coalesce("confidence", F.lit(0.0))
    finding = F.when(s < 0.3, "key_difference").when(s > 0.7, "key_similarity")
    return out.select("a", "b", s.alias("similarity"), F.coalesce("kind", F.lit("unrelated")).alias("kind"), "overlap", "structure", finding.alias("finding"))


def relatives(related: DataFrame, k: int = 10) -> DataFrame:
    """(doc, other, kind, confidence, rank): the ``k`` surest relationships of every document, ties to the smaller other."""
    both = related.select(F.col("a").alias("doc"), F.col("b").alias("other"), "kind", "confidence").unionByName(related.select(F.col("b").alias("doc"), F.col("a").alias("other"), "kind", "confidence"))
    order = Window.partitionBy("doc").orderBy(F.desc(F.round("confidence", 9)), "other")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def relationship_counts(related: DataFrame) -> DataFrame:
    """(doc, total and the number of each kind) over all relationships of each document."""
    both = related.select(F.col("a").alias("doc"), "kind").unionByName(related.select(F.col("b").alias("doc"), "kind"))
    return both.groupBy("doc").agg(F.count("*").alias("total"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("similar", "complementary", "conflicting", "referential")])


def contributions(title: Column, summary: Column) -> Column:
    """The first three sentences of a summary, without empty ones; without any, a line with the title."""
    said = F.filter(F.transform(F.slice(F.split(F.coalesce(summary, F.lit("")), r"\."), 1, 3), t.strip), lambda s: s != "")
    return F.when(F.size(said) > 0, said).otherwise(F.array(F.concat(F.lit("Document: "), F.coalesce(title, F.lit("")))))


def unified_summary(documents: DataFrame, most: int = 500) -> DataFrame:
    """One row: the summaries (without any, the titles) in the order of documents, joined by blanks, the first ``most`` characters."""
    known = bounded(documents.select("doc", "title", "summary"))
    line = lambda c, keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("doc", F.col(c).alias("x"))))), lambda z: z["x"]), " ")
    return known.agg(F.substring(F.coalesce(F.nullif(line("summary", F.length("summary") > 0), F.lit("")), line("title", F.col("title").isNotNull())), 1, most).alias("summary"))


def knowledge_gaps(topics: DataFrame, related: DataFrame, documents: int) -> DataFrame:
    """(gap, severity) of a set: fewer than five topics (term, docs) in several documents; fewer strong relationships than a chain needs."""
    broad = topics.agg(F.count_if(F.col("docs") > 1).alias("broad"))
    edges = related.agg(F.count_if(F.col("confidence") > 0.5).alias("edges"))
    found = F.array_compact(F.array(
        F.when(F.col("broad") < 5, F.struct(F.lit("breadth").alias("gap"), F.lit("medium").alias("severity"))),
        F.when(F.col("edges") < documents - 1, F.struct(F.lit("connectivity").alias("gap"), F.lit("low").alias("severity"))),
    ))
    return broad.crossJoin(edges).select(F.explode(found).alias("x")).select("x.*")  # one row each
