"""Layout: text boxes grouped into tables by their places on a page, and tables put into the texts that they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import tables as tb

# Distance of centres of one line, gap below which boxes belong together, least boxes and columns of a table.
ALIGNED, GAP, ROWS, COLUMNS = 10.0, 20.0, 2, 2
#: Boxes of one task.
IN_TASK = 500_000
# What ends a table's section in a text.
SECTION_ENDS = ("\n\n## ", "\n\n# ", "\n\n--- Page", "\n\n**Table", "\n\n<!-- TABLE")


def box_groups(boxes: DataFrame, page: str = "page", in_task: int = IN_TASK) -> DataFrame:
    """``boxes`` (page, id, x0, y0, x1, y1) with ``box_group`` (from 0 by page), ``row`` (from 0 in the group), ``column`` (from 0 in the row) and ``is_table``.

    Boxes go from top to bottom (ties: smaller id); a group ends where the next box is not on the line of the one before (centres at
    least ``ALIGNED`` apart) or not near it (at least ``GAP`` below).  A row ends where the next box shares no more
    than half of the lower one's height with the one before.  Groups of one box stay, as no tables; a group is a table with at least ``ROWS`` boxes at ``COLUMNS`` left edges (to whole points, halves to even).
    Boxes with a null side break their group; a page's boxes meet in one window, which is a page's size.  Boxes are dealt by page so that
    a task sorts about ``in_task`` of them, however many there are.
    """
    n = boxes.count()
    if n > in_task:
        boxes = boxes.repartition(max(boxes.sparkSession.sparkContext.defaultParallelism, -(-n // in_task)), page)
    order = Window.partitionBy(page).orderBy(F.col("y0").asc_nulls_last(), "id")
    centre = (F.col("y0") + F.col("y1")) / 2
    near = (F.abs(centre - F.lag(centre).over(order)) < ALIGNED) & (F.col("y0") - F.lag("y1").over(order) < GAP)
    shared = F.least("y1", F.lag("y1").over(order)) - F.greatest("y0", F.lag("y0").over(order))
    lies = shared > 0.5 * F.least(F.col("y1") - F.col("y0"), F.lag("y1").over(order) - F.lag("y0").over(order))
    marked = boxes.withColumn("_new", (~F.coalesce(near, F.lit(False))).cast("int")).withColumn("_row", (~F.coalesce(lies, F.lit(False))).cast("int"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    starts = F.col("_new") == 1
    grouped = marked.withColumn("box_group", (F.sum("_new").over(upto) - 1).cast("int")).withColumn("_rows", F.sum(F.when(starts, 0).otherwise(F.col("_row"))).over(upto))
    rows = grouped.withColumn("row", (F.col("_rows") - F.max(F.when(starts, F.col("_rows"))).over(upto)).cast("int"))
    column = F.row_number().over(Window.partitionBy(page, "box_group", "row").orderBy(F.col("x0").asc_nulls_last(), "id")) - 1
    whole = Window.partitionBy(page, "box_group")  # sorted already
    edges = F.size(F.collect_set(F.bround("x0")).over(whole))
    table = (F.count("*").over(whole) >= ROWS) & (edges >= COLUMNS)
    return rows.withColumn("column", column.cast("int")).withColumn("is_table", table).drop("_new", "_row", "_rows")


def table_block(number: Column, caption: Column, method: Column, confidence: Column, body: Column) -> Column:
    """The marked text of a table: its number and caption, how it was extracted, its Markdown."""
    n = number.cast("string")
    named = F.when(F.length(caption) > 0, F.concat(F.lit(": "), caption)).otherwise("")
    said = F.concat(F.lit("\n*Extracted with "), method, F.lit(" (confidence: "), F.format_string("%.2f", confidence), F.lit(")*\n\n"))
    return F.concat(F.lit("\n\n<!-- TABLE_START: Table "), n, F.lit(" -->\n**Table "), n, F.lit("**"), named, said, body, F.lit("\n<!-- TABLE_END: Table "), n, F.lit(" -->\n"))


def merge_tables(documents: DataFrame, tables: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, merged): each document's text with its tables (id, table, headers, rows, caption, page (from 0), method, confidence) put in.

    A table replaces the text from the first of its first three headers (of more than three signs) that stands there, up to the next section; without
    one it follows its page's marker; without that it is appended.  All places are looked up in the original text and taken in one pass, in order of place and table number; what
    one table has replaced, another is not looked for in, but put behind.  A document without tables keeps its text; null texts count as empty
    where there are tables; tables of unknown documents are left out; a document's tables meet in one row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = F.filter(F.slice("headers", 1, 3), lambda h: F.length(h) > 3)
    at = F.get(F.filter(F.transform(named, lambda h: F.call_function("locate", h, F.col("_text"))), lambda p: p > 0), F.lit(0))
    marker = F.concat(F.lit("--- Page "), (F.col("page") + 1).cast("string"), F.lit(" ---"))
    page_at = F.call_function("locate", marker, F.col("_text"))
    ends = F.array_min(F.filter(F.array(*(F.call_function("locate", F.lit(m), F.col("_text"), F.col("_at") + 1) for m in SECTION_ENDS)), lambda p: p > 0))
    block = table_block(F.col("table"), F.col("caption"), F.col("method"), F.col("confidence"), tb.markdown(F.col("headers"), F.col("rows"), F.col("caption")))
    met = tables.join(documents.select(id_col, text.alias("_text")), id_col).withColumn("_at", at).withColumn("_page_at", page_at)
    after = F.col("_page_at") + F.length(marker) - 1  # signs before the insertion
    size = F.length("_text")
    start = F.when(F.col("_at").isNotNull(), F.col("_at") - 1).when(F.col("_page_at") > 0, after).otherwise(size)
    end = F.when(F.col("_at").isNotNull(), F.coalesce(ends - 1, size)).otherwise(start)
    put = F.when(F.col("_at").isNotNull(), block).otherwise(F.concat(F.lit("\n\n"), block))
    edits = met.select(id_col, F.struct(start.alias("start"), F.col("table").alias("table"), end.alias("end"), put.alias("put")).alias("e")).groupBy(id_col).agg(F.array_sort(F.collect_list("e")).alias("_e"))
    joined = documents.join(edits, id_col, "left").withColumn("_text", text)
    # how far the text has been used before each edit
    used = F.aggregate("_e", F.array(F.lit(0)), lambda done, e: F.array_append(done, F.greatest(F.element_at(done, -1), e["end"])))
    pieces = F.transform("_e", lambda e, k: F.concat(F.call_function("substring", F.col("_text"), F.get("_used", k) + 1, F.greatest(e["start"] - F.get("_used", k), F.lit(0))), e["put"]))
    tail = F.call_function("substring", F.col("_text"), F.element_at("_used", -1) + 1, F.length("_text"))
    whole = F.when(F.col("_e").isNull(), F.col(text_col)).otherwise(F.concat(F.array_join(pieces, ""), tail))
    return joined.withColumn("_used", used).select(id_col, text_col, whole.alias("merged"))
