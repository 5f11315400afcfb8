"""Queries over marked tables: one document per nation with three tables made of its customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import tables as tb
from docloom.plans.registry import query
from docloom.sources.tables import table

WIDE = ("segment", "customers", "first", "last", "money", "day", "part", "words")
#: Questions asked of the tables.
QUESTIONS = (
    (1, "What is the total customers column for Table 2?"), (2, "Compare the segment values versus the key data"), (3, "highest first in segment between 1 and 3"),
    (4, "Tell me about the weather"), (5, "growth of money for customers in table segments"), (6, "Average share data"),
)
ANSWERS = ((1, "Table 1 says that row 3 has 12 customers in total"), (2, "The ratio is 0.123456789 for Q2"), (3, "No figures at all"), (4, "There are 1 2 3 and 99999999 of them"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """(doc, text): a report per nation with three marked tables."""
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    n, lo, hi = (F.col(x).cast("string") for x in ("n", "lo", "hi"))
    seg = c.groupBy("n_nationkey", "n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.min("c_custkey").alias("lo"), F.max("c_custkey").alias("hi"))
    line = lambda *cs: F.concat(F.lit("| "), F.concat_ws(" | ", *cs), F.lit(" |"))
    joined = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(x)), lambda y: y["line"]), "\n")
    wide = line("c_mktsegment", n, lo, F.concat(hi, F.lit(",000")), F.concat(F.lit("$"), n), F.lit("2024-01-05"), F.concat(F.lit("about "), n, F.lit("%")), F.lit("USD five"))
    a = seg.groupBy("n_nationkey", "n_name").agg(
        joined(F.struct("c_mktsegment", line("c_mktsegment", n, F.concat(n, F.lit("%"))).alias("line"))).alias("small"), joined(F.struct("c_mktsegment", wide.alias("line"))).alias("wide")
    )
    b = c.groupBy("n_nationkey").agg(joined(F.struct("c_custkey", line(F.col("c_custkey").cast("string"), "c_name", "c_mktsegment").alias("line"))).alias("list"))
    text = F.concat(
        F.lit("Report of "), "n_name", F.lit("\n\n<!-- TABLE_START: segments -->\n**Table 1**: Customers of "), "n_name", F.lit("\nExtracted with Camelot, confidence: 0.85\nPage 3\n| segment | customers | share |\n| --- | --- | --- |\n"), "small",
        F.lit("\n\n| not | a | row |\n<!-- TABLE_END: segments -->\nText between.\n<!-- TABLE_START: list -->\n| key | name | segment |\n|---|---|---|\n"), "list", F.lit("\n<!-- TABLE_END: list -->\n"),
        F.lit("<!-- TABLE_START: wide -->\nPage 12\n| " + " | ".join(WIDE) + " |\n|---|\n"), "wide", F.lit("\n<!-- TABLE_END: wide -->\n<!-- TABLE_START: none -->\n| alone |\n<!-- TABLE_END: none -->\nThe end of "), "n_name",
    )
    return a.join(b, "n_nationkey").select(F.col("n_nationkey").alias("doc"), text.alias("text"))


def marked(spark: SparkSession, sf: str) -> DataFrame:
    return tb.marked(documents(spark, sf), "doc", "text")


def enhanced(spark: SparkSession, sf: str) -> DataFrame:
    return tb.enhanced(tb.chunks(marked(spark, sf), "doc"))


# The same tables straight from their rows: nothing is parsed in SQL.
_SEG = "(SELECT n_nationkey AS doc, n_name, c_mktsegment AS s, count(*) AS n, min(c_custkey) AS lo, max(c_custkey) AS hi FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"
_ROWS = f"""(SELECT doc, 1 AS tab, s AS o, [s, CAST(n AS VARCHAR), n || '%'] AS r FROM {_SEG} UNION ALL SELECT c_nationkey, 2, lpad(CAST(c_custkey AS VARCHAR), 20, '0'), [CAST(c_custkey AS VARCHAR), c_name, c_mktsegment] FROM customer
  UNION ALL SELECT doc, 3, s, [s, CAST(n AS VARCHAR), CAST(lo AS VARCHAR), hi || ',000', '$' || n, '2024-01-05', 'about ' || n || '%', 'USD five'] FROM {_SEG})"""
_TABLES = f"""(SELECT doc, tab, list(r ORDER BY o) AS rows, CASE tab WHEN 1 THEN ['segment', 'customers', 'share'] WHEN 2 THEN ['key', 'name', 'segment'] ELSE {list(WIDE)} END AS headers,
  CASE tab WHEN 1 THEN 'Customers of ' || (SELECT n_name FROM nation WHERE n_nationkey = doc) END AS caption, CASE tab WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 11 END AS page,
  CASE tab WHEN 1 THEN 'camelot' ELSE 'text_based' END AS method, CASE tab WHEN 1 THEN 0.85 ELSE 0.7 END AS confidence FROM {_ROWS} GROUP BY doc, tab)"""
_KIND = "CASE WHEN len(rows) <= 5 AND len(headers) <= 4 THEN 'complete' WHEN len(rows) > 10 THEN 'horizontal' WHEN len(headers) > 6 THEN 'vertical' ELSE 'semantic' END"
_SLICED = f"""(SELECT *, unnest(CASE kind WHEN 'horizontal' THEN range(0, len(rows), 10) WHEN 'vertical' THEN range(0, len(headers), 4) ELSE [0] END) AS f FROM (SELECT *, {_KIND} AS kind FROM {_TABLES}))"""
_PARTS = f"""(SELECT *, CASE kind WHEN 'horizontal' THEN least(f + 10, len(rows)) WHEN 'vertical' THEN least(f + 4, len(headers)) ELSE len(rows) END AS e,
  CASE kind WHEN 'vertical' THEN headers[f + 1:f + 4] ELSE headers END AS h, CASE kind WHEN 'horizontal' THEN rows[f + 1:f + 10] WHEN 'vertical' THEN list_transform(rows, lambda r: r[f + 1:f + 4]) ELSE rows END AS p FROM {_SLICED})"""
_CHUNKS = f"""(SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY tab, f) - 1 AS INT) AS chunk_index, CAST(tab AS INT) AS "table", CASE kind WHEN 'horizontal' THEN 'table_horizontal_slice' WHEN 'vertical' THEN 'table_vertical_slice' ELSE 'table_complete' END AS chunk_type,
  'Table ' || tab || CASE kind WHEN 'horizontal' THEN ' (Rows ' || (f + 1) || '-' || e || ')' WHEN 'vertical' THEN ' (Columns ' || (f + 1) || '-' || e || ')' ELSE '' END AS section_title,
  '| ' || array_to_string(h, ' | ') || ' |' || chr(10) || '|' || array_to_string(list_transform(h, lambda x: ' --- '), '|') || '|' || chr(10) || array_to_string(list_transform(p, lambda r: '| ' || array_to_string(r, ' | ') || ' |'), chr(10))
    || CASE WHEN caption IS NULL THEN '' ELSE chr(10) || '*Table: ' || caption || '*' END AS chunk_text,
  CAST(CASE kind WHEN 'horizontal' THEN f ELSE 0 END AS INT) AS first_row, CAST(CASE kind WHEN 'horizontal' THEN e - 1 ELSE len(rows) - 1 END AS INT) AS last_row,
  CAST(CASE kind WHEN 'vertical' THEN f ELSE 0 END AS INT) AS first_column, CAST(CASE kind WHEN 'vertical' THEN e - 1 ELSE len(headers) - 1 END AS INT) AS last_column, CAST(page + 1 AS INT) AS page_number, CAST(confidence AS DOUBLE) AS confidence, h, p FROM {_PARTS})"""
_TOKENS = "CAST(len(regexp_extract_all(chunk_text, '\\S+')) AS INT)"


@query(f"""SELECT doc, CAST(tab AS INT) AS "table", ['segments', 'list', 'wide'][tab] AS name, headers, CAST(len(rows) AS INT) AS n_rows, rows[len(rows)] AS last_row, caption, CAST(page AS INT) AS page, method, CAST(confidence AS DOUBLE) AS confidence FROM {_TABLES}""")
def table_marked(spark: SparkSession, sf: str) -> DataFrame:
    return marked(spark, sf).select("doc", "table", "name", "headers", F.size("rows").alias("n_rows"), F.element_at("rows", -1).alias("last_row"), "caption", "page", "method", "confidence")


@query(f"SELECT * EXCLUDE (h, p), {_TOKENS} AS token_count FROM {_CHUNKS}")
def table_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return tb.chunks(marked(spark, sf), "doc")


@query(f"""SELECT doc, chunk_type AS kind, chunk_index, section_title, sha256(chunk_text) AS chunk_sha256 FROM {_CHUNKS} UNION ALL
  SELECT n_nationkey, 'text', 0, NULL, sha256('Report of ' || n_name || chr(10) || chr(10) || 'Text between.' || chr(10) || chr(10) || 'The end of ' || n_name) FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)""")
def table_aware_chunks(spark: SparkSession, sf: str) -> DataFrame:
    made = tb.table_aware(documents(spark, sf), "doc", "text", least=1)
    return made.select("doc", "kind", "chunk_index", F.when(F.col("kind") != "text", F.col("section_title")).alias("section_title"), F.sha2("chunk_text", 256).alias("chunk_sha256"))


@query(f"SELECT chunk_type, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER ({_TOKENS} < 50) AS small FROM {_CHUNKS} GROUP BY chunk_type")
def table_chunk_report(spark: SparkSession, sf: str) -> DataFrame:
    return tb.chunk_report(tb.chunks(marked(spark, sf), "doc")).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query(f"""SELECT doc, count(*) AS tables, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (len(rows) <= 5 OR len(rows) <= 10 AND len(headers) <= 5) AS simple, count(*) FILTER (len(rows) BETWEEN 6 AND 10 AND len(headers) > 5) AS complex,
  count(*) FILTER (len(rows) > 10) AS very_complex, count(*) FILTER (method = 'camelot') AS camelot, count(*) FILTER (method = 'text_based') AS text_based FROM {_TABLES} GROUP BY doc""")
def table_file_report(spark: SparkSession, sf: str) -> DataFrame:
    r = tb.file_report(marked(spark, sf), "doc")
    return r.select("doc", "tables", F.round("mean_confidence", 6).alias("mean_confidence"), "simple", "complex", "very_complex", *[F.col("methods")[m].alias(m) for m in ("camelot", "text_based")])


_TYPES = "list_transform(h, lambda x: CASE WHEN x IN ('customers', 'share', 'first', 'last', 'money', 'key') THEN 'numerical' WHEN x = 'day' THEN 'date' WHEN x = 'part' THEN 'percentage' WHEN x = 'words' THEN 'currency' ELSE 'text' END)"
_ENHANCED = f"""(SELECT *, list_filter(h, lambda x: x NOT IN ('day', 'segment', 'name')) AS numerical_columns, least(2, CASE chunk_type WHEN 'table_complete' THEN 1.2 ELSE 1 END * (confidence + 0.5)) AS boost FROM {_CHUNKS})"""
_SUMMARY = """'Table with columns: ' || array_to_string(h, ', ') || CASE WHEN len(numerical_columns) > 0 THEN '. Numerical data in: ' || array_to_string(numerical_columns, ', ') ELSE '' END || '. Contains ' || len(p) || ' data rows'"""


@query(f"SELECT doc, chunk_index, h AS headers, {_TYPES} AS types, numerical_columns, len(numerical_columns) > 0 AS aggregation_capable, len(h) > 1 AS comparison_capable, round(boost, 6) AS boost, {_SUMMARY} AS summary FROM {_ENHANCED}")
def table_enhanced(spark: SparkSession, sf: str) -> DataFrame:
    return enhanced(spark, sf).select("doc", "chunk_index", "headers", "types", "numerical_columns", "aggregation_capable", "comparison_capable", F.round("boost", 6).alias("boost"), "summary")


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUESTIONS), "query_id int, query string").withColumn("question", tb.question(F.col("query")))


_ASKED = f"(SELECT * FROM (VALUES {', '.join(map(str, QUESTIONS))}) AS q(query_id, query))"
_CONTEXT = f"""(SELECT query_id, query, regexp_matches(lower(query), '{'|'.join(tb.AGGREGATIONS)}') AS aggregation, regexp_matches(lower(query), '{'|'.join(tb.COMPARISONS)}') AS comparison,
  flatten([{', '.join(f"regexp_extract_all(lower(query), '{p}', 1)" for p in tb.COLUMN_NAMES)}]) AS columns, nullif(regexp_extract(lower(query), 'table\\s+(\\w+)', 1), '') AS target FROM {_ASKED})"""


@query(f"SELECT CAST(query_id AS INT) AS query_id, aggregation, comparison, columns, target FROM {_CONTEXT}")
def table_questions(spark: SparkSession, sf: str) -> DataFrame:
    return _questions(spark).select("query_id", "question.*")


_PRIORITY = f"""(SELECT query_id, doc, chunk_index, chunk_text, confidence, {_SUMMARY} AS summary, round(CASE WHEN aggregation AND len(numerical_columns) > 0 THEN 1.5 ELSE 1 END * CASE WHEN comparison AND len(h) > 1 THEN 1.3 ELSE 1 END
  * (1 + 0.1 * len(list_distinct(list_intersect(columns, h)))) * boost, 6) AS priority FROM {_ENHANCED}, {_CONTEXT})"""
_RANKED = f"(SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, doc, chunk_index) AS INT) AS rank FROM {_PRIORITY}) WHERE rank <= 10)"


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    scored = tb.prioritised(enhanced(spark, sf).crossJoin(F.broadcast(_questions(spark)))).withColumn("priority", F.round("priority", 6))  # six stated questions
    w = Window.partitionBy("query_id").orderBy(F.desc("priority"), "doc", "chunk_index")
    return scored.withColumn("rank", F.row_number().over(w)).where("rank <= 10")


@query(f"SELECT CAST(query_id AS INT) AS query_id, rank, doc, chunk_index, CAST(priority AS DOUBLE) AS priority FROM {_RANKED}")
def table_priority(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf).select("query_id", "rank", "doc", "chunk_index", "priority")


@query(f"""SELECT CAST(query_id AS INT) AS query_id, 'Here are relevant tables from the document:' || chr(10) || string_agg(chr(10) || 'Table ' || rank || ':' || chr(10) || 'Summary: ' || summary || chr(10) || chunk_text, chr(10) ORDER BY rank) AS context
  FROM {_RANKED} WHERE rank <= 3 GROUP BY query_id""")
def table_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return tb.prompt(_ranked(spark, sf), "query_id")


_LISTED = "(SELECT * FROM (VALUES " + ", ".join(map(str, ANSWERS)) + ") AS a(answer_id, response))"


@query(f"""WITH t AS (SELECT doc, list(chunk_text) AS texts FROM {_CHUNKS} GROUP BY doc), a AS (SELECT answer_id, response, regexp_extract_all(response, '\\b\\d+\\.?\\d*\\b') AS nums FROM {_LISTED}),
  v AS (SELECT answer_id, doc, regexp_matches(lower(response), '{'|'.join(tb.REFERENCES)}') AS refers, len(nums) AS n, len(list_filter(nums[1:3], lambda x: len(list_filter(texts, lambda y: contains(y, x))) > 0)) > 0 AS seen,
    {' OR '.join(f"contains(lower(response), '{w}')" for w in tb.CALCULATIONS)} AS calculates FROM a, t)
  SELECT CAST(answer_id AS INT) AS answer_id, doc, refers, CASE WHEN n = 0 THEN 'unknown' WHEN seen THEN 'verified_in_tables' ELSE 'needs_verification' END AS accuracy, calculates, round(0.5 + CASE WHEN seen THEN 0.3 ELSE 0 END + CASE WHEN refers THEN 0.2 ELSE 0 END, 6) AS confidence FROM v""")
def table_answers(spark: SparkSession, sf: str) -> DataFrame:
    asked = F.broadcast(spark.createDataFrame(list(ANSWERS), "answer_id int, response string"))  # four stated answers
    made = tb.chunks(marked(spark, sf), "doc").select("doc", "chunk_text").crossJoin(asked)
    each = made.select("answer_id", "doc", tb.answer_check(F.col("response"), F.array("chunk_text")).alias("x")).select("answer_id", "doc", "x.*")
    # chunk by chunk: a number seen in one is seen in the document, and the greater word and confidence say so
    best = each.groupBy("answer_id", "doc").agg(*[F.max(c).alias(c) for c in ("refers", "accuracy", "calculates", "confidence")])
    return best.withColumn("confidence", F.round("confidence", 6))


@query("""WITH RECURSIVE b AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY -l_extendedprice, l_linenumber) AS k, CAST(l_linenumber AS INT) AS id, l_partkey % 10 AS x0, l_suppkey % 10 AS y0, l_partkey % 10 + 4 + l_linenumber AS x1, l_suppkey % 10 + 4 AS y1 FROM lineitem),
  r AS (SELECT page, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(id INT, x0 BIGINT, y0 BIGINT, x1 BIGINT, y1 BIGINT)[]) AS kept FROM (SELECT DISTINCT page FROM b)
    UNION ALL SELECT r.page, b.k, CASE WHEN len(list_filter(r.kept, lambda z: greatest(0, least(z.x1, b.x1) - greatest(z.x0, b.x0)) * greatest(0, least(z.y1, b.y1) - greatest(z.y0, b.y0)) / least((z.x1 - z.x0) * (z.y1 - z.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) > 0.5)) > 0
      THEN r.kept ELSE list_append(r.kept, {'id': b.id, 'x0': b.x0, 'y0': b.y0, 'x1': CAST(b.x1 AS BIGINT), 'y1': b.y1}) END FROM r JOIN b ON b.page = r.page AND b.k = r.k + 1)
  SELECT page, unnest(list_transform(kept, lambda z: z.id)) AS id FROM (SELECT page, max_by(kept, k) AS kept FROM r GROUP BY page)""")
def distinct_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """The order lines as boxes on the page of their order, surest the dearest."""
    x0, y0 = F.col("l_partkey") % 10, F.col("l_suppkey") % 10
    boxes = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("int").alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + 4 + F.col("l_linenumber")).alias("x1"), (y0 + 4).alias("y1"), F.col("l_extendedprice").alias("confidence")
    )
    return tb.distinct_boxes(boxes, "page")
