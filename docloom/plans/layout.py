"""Queries of layout groups and of tables merged into texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import layout
from docloom.operators import tables as tb
from docloom.plans.registry import query
from docloom.plans.streams import _PARSED
from docloom.sources.tables import table

# boxes of a page are the lines of an order: some on one line, some below, some far away
_BOXES = """(SELECT l_orderkey AS page, l_linenumber + 10 * (l_partkey + 10000000 * l_suppkey) AS id, CAST(l_partkey % 5 * 60 AS DOUBLE) + 0.5 AS x0, CAST(l_linenumber // 3 * 14 + l_suppkey % 4 * 3 AS DOUBLE) AS y0,
  CAST(l_partkey % 5 * 60 + 50 AS DOUBLE) AS x1, CAST(l_linenumber // 3 * 14 + l_suppkey % 4 * 3 + 9 AS DOUBLE) AS y1 FROM lineitem)"""


@query(f"""WITH l AS (SELECT *, lag(y0) OVER w AS p0, lag(y1) OVER w AS p1 FROM {_BOXES} WINDOW w AS (PARTITION BY page ORDER BY y0, id)),
  g AS (SELECT *, CAST(sum(CASE WHEN abs((y0 + y1) / 2 - (p0 + p1) / 2) < 10 AND y0 - p1 < 20 THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY y0, id) - 1 AS INT) AS g FROM l),
  r AS (SELECT *, CAST(sum(CASE WHEN f = 1 OR least(y1, p1) - greatest(y0, p0) > 0.5 * least(y1 - y0, p1 - p0) THEN 0 ELSE 1 END) OVER (PARTITION BY page, g ORDER BY y0, id) AS INT) AS r FROM (SELECT *, row_number() OVER (PARTITION BY page, g ORDER BY y0, id) AS f FROM g))
  SELECT page, id, g AS box_group, r AS "row", CAST(row_number() OVER (PARTITION BY page, g, r ORDER BY x0, id) - 1 AS INT) AS "column",
    count(*) OVER (PARTITION BY page, g) >= 2 AND len(list_distinct(list(round_even(x0, 0)) OVER (PARTITION BY page, g))) >= 2 AS is_table FROM r""")
def box_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of orders as boxes of pages, grouped into tables."""
    i = table(spark, sf, "lineitem")
    x, y = F.col("l_partkey") % 5 * 60, F.floor(F.col("l_linenumber") / 3) * 14 + F.col("l_suppkey") % 4 * 3
    boxes = i.select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") + 10 * (F.col("l_partkey") + 10_000_000 * F.col("l_suppkey"))).alias("id"), (x.cast("double") + 0.5).alias("x0"), y.cast("double").alias("y0"), (x + 50).cast("double").alias("x1"), (y + 9).cast("double").alias("y1"))
    return layout.box_groups(boxes).select("page", "id", "box_group", "row", "column", "is_table")


_ROW = "'| ' || array_to_string({c}, ' | ') || ' |'"
_MD = f"""{_ROW.format(c='t[1]')} || chr(10) || '|' || array_to_string(list_transform(t[1], lambda x: ' --- '), '|') || '|' || chr(10) || array_to_string(list_transform(t[2:], lambda y: {_ROW.format(c='y')}), chr(10)) || chr(10) || '*Table: of ' || doc_id || '*'"""
_ENDS = ", ".join("'" + m.replace("\n", "' || chr(10) || '") + "'" for m in layout.SECTION_ENDS).replace("'' || ", "")


@query(f"""WITH p AS (SELECT doc_id, "table" + 1 AS n, t, text FROM {_PARSED} JOIN documents USING (doc_id)),
  b AS (SELECT *, list_filter(list_transform(list_filter(t[1][1:3], lambda h: length(h) > 3), lambda h: instr(text, h)), lambda x: x > 0)[1] AS pos, instr(text, '--- Page ' || n || ' ---') AS pg,
    chr(10) || chr(10) || '<!-- TABLE_START: Table ' || n || ' -->' || chr(10) || '**Table ' || n || '**: of ' || doc_id || chr(10) || '*Extracted with parser (confidence: 0.75)*' || chr(10) || chr(10) || {_MD} || chr(10) || '<!-- TABLE_END: Table ' || n || ' -->' || chr(10) AS block FROM p),
  e AS (SELECT doc_id, n, text, CASE WHEN pos IS NOT NULL THEN pos - 1 WHEN pg > 0 THEN pg - 1 + length('--- Page ' || n || ' ---') ELSE length(text) END AS s,
    CASE WHEN pos IS NOT NULL THEN coalesce(list_min(list_filter(list_transform([{_ENDS}], lambda m: CASE WHEN instr(substr(text, CAST(pos + 1 AS INT)), m) > 0 THEN pos + instr(substr(text, CAST(pos + 1 AS INT)), m) END), lambda x: x IS NOT NULL)) - 1, length(text)) END AS f,
    CASE WHEN pos IS NULL THEN chr(10) || chr(10) ELSE '' END || block AS put FROM b),
  u AS (SELECT *, coalesce(max(coalesce(f, s)) OVER (PARTITION BY doc_id ORDER BY s, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM e),
  j AS (SELECT doc_id, string_agg(substr(text, CAST(used + 1 AS INT), CAST(greatest(s - used, 0) AS INT)) || put, '' ORDER BY s, n) || substr(any_value(text), CAST(max(greatest(used, coalesce(f, s))) + 1 AS INT)) AS merged FROM u GROUP BY doc_id)
  SELECT doc_id, length(coalesce(merged, text)) AS chars, md5(coalesce(merged, text)) AS digest FROM documents LEFT JOIN j USING (doc_id)""")
def tables_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with the tables of its text put back as marked tables."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = tb.parse(docs, "doc_id", "text").select(
        "doc_id", (F.col("table") + 1).alias("table"), "headers", "rows", F.concat(F.lit("of "), F.col("doc_id").cast("string")).alias("caption"), F.col("table").alias("page"), F.lit("parser").alias("method"), F.lit(0.75).alias("confidence")
    )
    merged = layout.merge_tables(docs, found)
    return merged.select("doc_id", F.length("merged").cast("long").alias("chars"), F.md5("merged").alias("digest"))
