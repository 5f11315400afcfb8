"""Vector blocks, page boosts and readers on small tables."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import search

V = "chunk_id long, embedding array<double>, pages array<int>"
Q = "query_id long, q array<double>, query string"


def test_vectors_of_different_length_are_refused(spark):
    good = spark.createDataFrame([(1, [1.0, 0.0, 0.0], None)], V)
    for rows, q in (([(1, [1.0], None), (2, [2.0, 3.0, 4.0], None)], [1.0, 2.0]), ([(1, [1.0, 2.0], None)], [1.0])):
        with pytest.raises(Exception, match="length"):
            search.vector_hits(spark.createDataFrame(rows, V).coalesce(1), spark.createDataFrame([(0, q, "")], Q), 3).collect()
    assert search.vector_hits(good, spark.createDataFrame([(0, [2.0, 0.0, 0.0], "")], Q), 3).first()["similarity"] == 1.0


def test_page_boost_counts_before_the_cut(spark):
    rows = [(k, [1.0, k / 100], [k]) for k in range(40)] + [(100, None, [7]), (101, [1.0, 0.0], None), (102, [0.0, 0.0], [39, 7])]
    asked = [(0, [1.0, 0.0], "what is on page 39"), (1, [1.0, 0.0], "nothing named"), (2, [1.0, 0.0], None)]
    got = search.page_boosted_hits(spark.createDataFrame(rows, V), spark.createDataFrame(asked, Q), 3).collect()
    by = {q: [(r["chunk_id"], r["boosted"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in range(3)}
    assert [c for c, _ in by[0]] == [39, 0, 101] and by[0][0][1] > 1
    assert [c for c, _ in by[1]] == [c for c, _ in by[2]] == [0, 101, 1]


@pytest.mark.parametrize(("k", "threshold"), [(10, None), (20, 0.3), (None, 0.1)])
def test_blocks_meet_without_copies_of_each_other(spark, k, threshold):
    x = np.random.default_rng(5).integers(-3, 4, (2600, 5)).astype(float)  # many ties and some zero vectors
    rows = spark.createDataFrame([(i, v, None) for i, v in enumerate(x.tolist())] + [(9000, None, None)], V)
    asked = rows.where("chunk_id % 13 = 0 or chunk_id = 9000").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))
    hits = search.vector_hits(rows, asked, k, threshold)
    made = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in made and "CoGroup" in made  # each block of vectors was repeated, in one batch, for every block of queries
    size = np.sqrt((x * x).sum(1, keepdims=True))
    unit = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    want = []
    for q in range(0, 2600, 13):
        s = np.round(unit @ unit[q], 9)
        at = [int(i) for i in np.lexsort((np.arange(2600), -s)) if threshold is None or s[i] > threshold]
        want += [(q, i, r + 1) for r, i in enumerate(at[:k])]
    assert sorted((r["query_id"], r["chunk_id"], r["rank"]) for r in hits.collect()) == sorted(want)


def test_groups_of_long_vectors_hold_fewer(spark, monkeypatch):
    vector = F.array_repeat(F.col("id").cast("double"), 1 << 17)  # 1 MB each: all 100 met in one group
    rows, asked = spark.range(100).select(F.col("id").alias("chunk_id"), vector.alias("embedding")), spark.range(40).select(F.col("id").alias("query_id"), vector.alias("q"))
    made = search.block_scores(rows, asked, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(int, re.findall(r"pmod\(xxhash64\(.*?\), (\d+)\)", made))) == [2, 4]
    x = np.random.default_rng(6).standard_normal((60, 8))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "chunk_id long, embedding array<double>")
    asked = rows.toDF("query_id", "q")
    whole = sorted(search.vector_hits(rows, asked, 7).collect())
    monkeypatch.setattr(search, "NUMBERS", 8 * 11)
    assert sorted(search.vector_hits(rows, asked, 7).collect()) == whole and len(whole) == 420


def test_one_side_may_be_empty(spark):
    some, none = spark.createDataFrame([(1, [1.0, 2.0], None)], V), spark.createDataFrame([], V)
    asked = spark.createDataFrame([(0, [1.0, 0.0], "")], Q)
    assert search.vector_hits(none, asked, 3).count() == search.vector_hits(some, asked.where("query_id > 0"), 3).count() == 0


@pytest.mark.parametrize("before", [False, True])
def test_readers_keep_their_places(spark, before):
    matches = [(0, 5, k, k * 10, 1.0 - k // 2 / 10) for k in range(9)] + [(1, None, k, k * 10, 0.5) for k in range(4)]
    df = spark.createDataFrame(matches, "query_id long, user_id long, document_id long, chunk_id long, text_rank double")
    docs = spark.createDataFrame([(k, 5 if k % 3 == 0 else 6) for k in range(9)], "document_id long, owner long")
    got = sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in search.readable(df, docs, 2, before).collect())
    order = {q: [m for m in sorted(matches, key=lambda m: (-m[4], m[3])) if m[0] == q] for q in (0, 1)}
    want = []
    for q, rows in order.items():
        placed = [(q, n + 1, m[3]) for n, m in enumerate(rows) if m[1] is None or m[2] % 3 == 0]
        want += placed[:2] if before else [p for p in placed if p[1] <= 2]
    assert got == want
    assert search.readable(df.where(F.lit(False)), docs, 2, before).count() == 0
