"""Relationships between documents of a bounded set (a person's selection, or the sources of a corpus), and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Documents of a set whose pairs may be listed.
MOST = 2_000


def bounded(documents: DataFrame, most: int = MOST) -> DataFrame:
    """The documents of a set, which must be no more than ``most``."""
    if documents.limit(most + 1).count() > most:
        raise ValueError(f"relationships are listed for at most {most} documents; narrow the set")
    return documents


def overlaps(terms: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b, common, score) of the pairs a < b that share a term, by Jaccard, from distinct (doc, term).

    Documents meet at their terms, so the join grows with shared terms only.  The set is checked: of more than ``most``
    documents no pairs are listed (a term that all hold would list them all).
    """
    sizes = bounded(terms.groupBy("doc").agg(F.count("*").alias("size")), most)
    pairs = terms.select(F.col("doc").alias("a"), "term").join(terms.select(F.col("doc").alias("b"), "term"), "term").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    both = pairs.join(sizes.select(F.col("doc").alias("a"), F.col("size").alias("na")), "a").join(sizes.select(F.col("doc").alias("b"), F.col("size").alias("nb")), "b")
    return both.select("a", "b", "common", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("score"))


def structural(stats: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b, score) from (doc, mean_size, titles) of at most ``most`` documents: the mean of the sizes' and the titles' agreement."""
    stats = bounded(stats, most)
    a, b = (stats.select(*[F.col(c).alias(f"{c}_{s}") for c in ("doc", "mean_size", "titles")]) for s in "ab")
    pairs = a.join(F.broadcast(b), F.col("doc_a") < F.col("doc_b"))  # at most ``most`` documents
    size = F.coalesce(1 - F.try_divide(F.abs(F.col("mean_size_a") - F.col("mean_size_b")), F.greatest("mean_size_a", "mean_size_b")), F.lit(0.0))
    shared = F.coalesce(F.try_divide(F.size(F.array_intersect("titles_a", "titles_b")).cast("double"), F.greatest(F.size("titles_a"), F.size("titles_b"))), F.lit(0.0))
    return pairs.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"), ((size + shared) / 2).alias("score"))


def relationships(pairs: DataFrame, least: float = 0.3) -> DataFrame:
    """(a, b, kind, confidence) from (a, b, content, topic, structure); conflicts are told before complements."""
    c, t, s = F.col("content"), F.col("topic"), F.col("structure")
    kind = F.when(c > 0.7, "similar").when((t > 0.7) & (c < 0.3), "conflicting").when((t > 0.5) & (c < 0.3), "complementary").when(s > 0.6, "referential").otherwise("similar")
    return pairs.select("a", "b", kind.alias("kind"), ((c + t + s) / 3).alias("confidence")).where(F.col("confidence") >= least)


def topic_frequencies(terms: DataFrame, top: int = 20) -> DataFrame:
    """(term, docs, importance, coverage): the ``top`` terms in most documents, from distinct (doc, term)."""
    n = F.col("docs")
    counts = terms.groupBy("term").agg(F.count("*").alias("docs"))
    marked = counts.withColumn("importance", F.when(n > 2, "high").otherwise("medium")).withColumn("coverage", F.when(n > 3, "comprehensive").otherwise("partial"))
    return marked.orderBy(F.desc("docs"), "term").limit(top)


def coverage_depth(terms: DataFrame) -> DataFrame:
    """One row: topics in more than two, in two and in one document, and the share in more than one."""
    n = F.col("docs")
    return terms.groupBy("term").agg(F.count("*").alias("docs")).agg(
        F.count_if(n > 2).alias("deep"), F.count_if(n == 2).alias("moderate"), F.count_if(n == 1).alias("shallow"), F.coalesce(F.try_divide(F.count_if(n > 1).cast("double"), F.count("*")), F.lit(0.0)).alias("score")
    )


def gaps(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Expected (doc, term) that are missing in the document."""
    return expected.join(present, ["doc", "term"], "left_anti")


def timeline(documents: DataFrame, key: str, at: str, title: str) -> DataFrame:
    """Each row's place in its key's time order, the title before, and whether it is the first or last."""
    order = Window.partitionBy(key).orderBy(at, title)
    whole = Window.partitionBy(key)
    placed = documents.withColumn("place", F.row_number().over(order)).withColumn("before", F.lag(title).over(order)).withColumn("n", F.count("*").over(whole))
    return placed.withColumn("milestone", F.when(F.col("place") == 1, "first").when(F.col("place") == F.col("n"), "last")).drop("n")
