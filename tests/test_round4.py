"""Faults that showed on larger tables, on small inputs."""

from __future__ import annotations

import threading

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from docloom.functions import scores
from docloom.functions import text as t
from docloom.llm import topk
from docloom.operators import classify, search, tables, textindex
from docloom.plans import catalogue


def _long_lines(spark):
    rows = [(1, "word " * 30_000, "a"), (2, "Word and word\npage 4\n1. " + "Title Words " * 30_000, "b"), (3, "A short one, with stops.", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, filename string")


def test_headings_of_long_lines(spark):
    got = {(r["doc_id"], r["line"]): (r["level"], r["parent"]) for r in classify.hierarchy(classify.structure_lines(_long_lines(spark))).collect()}
    assert got == {(1, 0): (1, None), (2, 0): (1, None), (3, 0): (2, None)}


def test_structure_of_long_lines(spark):
    got = {r["doc_id"]: (r["page_count"], r["roots"]) for r in classify.structure(_long_lines(spark)).collect()}
    assert got == {1: (0, 1), 2: (1, 1), 3: (0, 1)}


def test_steady_patterns_find_the_same(spark):
    texts = ["Ab Cd:", "Ab Cd", "Ab Cd (2004)", "Ab  C d", "(Ab Cd, 2004, p. 3-4)", "[1, 2,3]", "[1, 2,]", "Section 1.2.3.", "ab cd ef", "ab c", "Ab\tCd"]
    patterns = [p for ps in t.HEADINGS.values() for p in ps] + scores.HEADERS + [p for _, ps in scores.FORMATS for p in ps]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    for p in patterns:
        assert df.where(F.rlike("x", F.lit(p)) != F.rlike("x", F.lit(t.steady(p)))).count() == 0


def test_means_that_round_to_zero_keep_their_sign(spark, tmp_path):
    rows = [(1, [-0.000004, 0.5, 0.000004, 0.0], 7), (2, [-0.000002, -0.25, 0.000002, 0.0], 7)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue.queries()["mean_pool_by_label"](spark, str(tmp_path)).first()["centroid"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert [repr(x) for x in got] == [repr(x) for x in con.execute(catalogue.oracle_sql()["mean_pool_by_label"]).fetchone()[1]] == ["-0.0", "0.125", "0.0", "0.0"]


def test_slices_take_only_their_own_rows_along(spark):
    n = 40_003
    rows = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.array(i.cast("string"), F.lit("some words of a cell")))
    one = spark.range(1).select(F.lit(1).alias("doc"), F.lit(1).alias("table"), F.array(F.lit("k"), F.lit("v")).alias("headers"), rows.alias("rows"), F.lit("c").alias("caption"), F.lit(0).alias("page"), F.lit(0.7).alias("confidence"))
    spark.sparkContext.setJobGroup("slices", "slices", True)
    stop = threading.Timer(60, lambda: spark.sparkContext.cancelJobGroup("slices"))  # a table beside each of its slices is 4,001 tables
    stop.start()
    try:
        made = tables.chunks(one, "doc").agg(F.count("*"), F.max("last_row"), F.max_by("chunk_text", "chunk_index"), F.max("chunk_index")).first()
    finally:
        stop.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tuple(made) == (4001, n - 1, "| k | v |\n| --- | --- |\n" + "\n".join(f"| {i} | some words of a cell |" for i in range(n - 2, n + 1)) + "\n*Table: c*", 4000)


def test_answers_are_checked_against_all_tables(spark, tmp_path):
    rows = [(i, 0, f"Customer#{i}", "BUILDING") for i in range(1, 31)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "A")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    got = {r["answer_id"]: tuple(r)[1:] for r in catalogue.queries()["table_answers"](spark, str(tmp_path)).collect()}
    assert got[1] == (0, True, "verified_in_tables", True, 1.0) and got[3][2] == "unknown"


def test_index_searches_shuffle_postings_not_pairs(spark, tmp_path):
    chunks = spark.range(3000).select(F.col("id").alias("chunk_id"), F.concat_ws(" ", F.lit("red green blue"), F.concat(F.lit("w"), F.col("id") % 7)).alias("chunk_text"), F.lit("en").alias("language"))
    index = textindex.build(chunks, f"file://{tmp_path}/index", block=500)
    asked = spark.range(40).select(F.col("id").alias("query_id"), F.lit("red blue").alias("query"))
    # no exploded entries of each query: words meet inside their block
    assert "Generate" not in textindex.text_matches(index, asked, 5)._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroupsInArrow")[0]
    assert "FlatMapCoGroupsInArrow" in textindex.text_matches(index, asked, 5)._jdf.queryExecution().optimizedPlan().toString()
    got = search.top(textindex.text_matches(index, asked, 5), 5, "text_rank", "chunk_id").collect()
    assert {(r["query_id"], r["chunk_id"]) for r in got} == {(q, c) for q in range(40) for c in range(5)}
    near = textindex.near_search(index, asked, 2)
    assert near.count() == 40 * 3000 and {r["span"] for r in near.select("span").distinct().collect()} == {2}


def test_long_queries_meet_at_their_rarest_word(spark):
    common = " ".join(f"common{i}" for i in range(40))
    docs = spark.range(8000).select(F.col("id").alias("chunk_id"), F.concat(F.lit(common + " own"), F.col("id")).alias("chunk_text")).repartition(4)
    asked = docs.select(F.col("chunk_id").alias("query_id"), F.col("chunk_text").alias("query")).union(spark.createDataFrame([(-1, "common1 absent"), (-2, "the")], "query_id long, query string"))
    spark.sparkContext.setJobGroup("rarest", "rarest", True)
    stop = threading.Timer(60, lambda: spark.sparkContext.cancelJobGroup("rarest"))  # 2,560,000,000 shared words
    stop.start()
    try:
        got = search.text_matches(docs, asked).agg(F.count("*"), F.count_if(F.col("query_id") == F.col("chunk_id"))).first()
    finally:
        stop.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tuple(got) == (8000, 8000)


def test_keywords_are_the_words_of_the_sql(spark):
    docs = spark.createDataFrame([(1, "Law\u0301 and contract, section_1 lawful LAW", "x")], "doc_id long, text string, title string")
    got = {r["document_type"]: (r["count"], r["top10"]) for r in classify.keyword_counts(docs).collect()}
    assert got["legal"] == (3, 3) and got["technical"] == (0, 0) and got["general"] == (0, 0)


def test_batches_without_usable_vectors():
    for rows in ([], [None, [], [float("nan"), 1.0]]):
        keep, made = topk.scaled_integers(pa.array(rows, pa.list_(pa.float64())), 256)
        assert len(keep) == 0 and made.shape[0] == 0
    assert topk.scaled_integers(pa.array([None, [0.5, -1.0]]), 256)[1].tolist() == [[128, -256]]
