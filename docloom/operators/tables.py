"""Tables in text: marked and plain Markdown tables, slices, column types, quality, chunks, retrieval priority, prompt context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as t
from docloom.operators import chunking

# The comments around a table, and what its text says about it.
MARKED = r"(?s)<!-- TABLE_START: (.+?) -->(.*?)<!-- TABLE_END: \1 -->"
ANY_MARKED = r"(?s)<!-- TABLE_START: .+? -->.*?<!-- TABLE_END: .+? -->"
CAPTION = r"\*\*Table \d+\*\*:?\s*(.+?)(?:\n|\*)"
METHOD = r"Extracted with (\w+).*?confidence:?\s*([\d.]+)"
PAGE = r"Page\s+(\d+)"
# Rows of a horizontal and columns of a vertical slice.
HEIGHT, WIDTH = 10, 4
# Patterns of questions about tables.
AGGREGATIONS = [r"sum\s+of", r"total\s+", r"average\s+", r"avg\s+", r"max\s+", r"min\s+", r"count\s+", r"highest\s+", r"lowest\s+", r"most\s+", r"least\s+", r"greater\s+than", r"less\s+than", r"between\s+"]
COMPARISONS = [r"compare\s+", r"vs\s+", r"versus\s+", r"difference\s+between", r"change\s+from", r"growth\s+", r"decline\s+", r"increase\s+", r"decrease\s+", r"better\s+than", r"worse\s+than"]
COLUMN_NAMES = [r"column\s+(\w+)", r"(\w+)\s+column", r"in\s+(\w+)", r"for\s+(\w+)", r"(\w+)\s+data", r"(\w+)\s+values"]
# What an answer about tables may hold.
REFERENCES = [r"table\s+\d+", r"row\s+\d+", r"column\s+\w+", r"q[1-4]", r"quarter\s+\d", r"in\s+the\s+table"]
CALCULATIONS = ["sum", "total", "average", "difference", "ratio"]
DATES = [r"\d{1,2}/\d{1,2}/\d{2,4}", r"\d{4}-\d{2}-\d{2}", r"[A-Za-z]{3}\s+\d{1,2},?\s+\d{4}", r"Q[1-4]\s+\d{4}"]


def is_row(line: Column) -> Column:
    """Whether a line holds a pipe and no rule."""
    return F.contains(line, F.lit("|")) & ~F.contains(line, F.lit("---"))


def table_lines(text: Column) -> Column:
    """The rows of the first table of a text: its lines with a pipe and no rule, up to the first blank line after them."""

    def of(lines: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: is_row(F.get(lines, i)))

        def upto(rows: Column) -> Column:
            blank = F.filter(F.sequence(F.get(rows, 0), F.size(lines) - 1), lambda i: t.strip(F.get(lines, i)) == "")
            return t.let(F.coalesce(F.get(blank, 0), F.size(lines)), lambda end: F.transform(F.filter(rows, lambda i: i < end), lambda i: F.get(lines, i)))

        return F.when(F.size(first) > 0, t.let(first, upto)).otherwise(F.array().cast("array<string>"))

    return t.let(t.lines(text), of)


def cells(line: Column) -> Column:
    """Trimmed cells between pipes; pipes at the ends of the line do not count."""
    return F.transform(F.split(F.btrim(t.strip(line), F.lit("|")), r"\|"), t.strip)


def parse(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, table, headers, rows): the tables of each text, numbered from 0; a blank line ends a table, one line alone is none.

    Null and empty texts have no tables; header and rows keep their own numbers of cells.
    """
    blocks = F.filter(F.transform(F.split(text_col, r"\n\s*\n"), lambda b: F.filter(t.lines(b), is_row)), lambda lines: F.size(lines) >= 2)
    each = documents.select(id_col, F.posexplode(blocks).alias("table", "lines"))
    return each.select(id_col, "table", cells(F.get("lines", 0)).alias("headers"), F.transform(F.slice("lines", 2, F.size("lines") - 1), cells).alias("rows"))


def marked(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, table, name, headers, rows, caption, page, method, confidence) of the tables between start and end comments of one name.

    ``table`` counts the tables with at least one data row from 1; ``page`` counts from 0 (0 without one); without a
    statement the method is ``text_based`` and the confidence 0.7.
    """
    spans = F.transform(F.regexp_extract_all(text_col, F.lit(MARKED), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, MARKED, 1).alias("name"), F.regexp_extract(x, MARKED, 2).alias("content")))
    found = F.transform(spans, lambda x: F.struct(x["name"].alias("name"), x["content"].alias("content"), table_lines(x["content"]).alias("lines")))
    each = documents.select(id_col, F.posexplode(F.filter(found, lambda x: F.size(x["lines"]) >= 2)).alias("table", "x")).select(id_col, (F.col("table") + 1).alias("table"), "x.*")
    confidence = t.first_group(F.col("content"), METHOD).isNotNull()
    return each.select(
        id_col, "table", "name", cells(F.get("lines", 0)).alias("headers"), F.transform(F.slice("lines", 2, F.size("lines") - 1), cells).alias("rows"), t.strip(t.first_group(F.col("content"), CAPTION)).alias("caption"),
        F.coalesce(t.first_group(F.col("content"), PAGE).try_cast("int") - 1, F.lit(0)).alias("page"), F.coalesce(F.lower(t.first_group(F.col("content"), METHOD)), F.lit("text_based")).alias("method"),
        F.coalesce(F.when(confidence, F.regexp_extract("content", METHOD, 2).try_cast("double")), F.lit(0.7)).alias("confidence"),
    )


def without_tables(text: Column) -> Column:
    return F.regexp_replace(text, ANY_MARKED, "")


def markdown(headers: Column, rows: Column, caption: Column) -> Column:
    """A table as Markdown (without rows: empty), with its caption below."""
    line = lambda cs: F.concat(F.lit("| "), F.array_join(cs, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(headers, lambda _: F.lit(" --- ")), "|"), F.lit("|"))
    below = F.when(F.length(caption) > 0, F.concat(F.lit("\n*Table: "), caption, F.lit("*"))).otherwise("")
    return F.when(F.size(rows) == 0, "").otherwise(F.concat(line(headers), F.lit("\n"), rule, F.lit("\n"), F.array_join(F.transform(rows, line), "\n"), below))


def strategy(rows: Column, columns: Column) -> Column:
    return F.when((rows <= 5) & (columns <= 4), "complete").when(rows > 10, "horizontal").when(columns > 6, "vertical").otherwise("semantic")


def _cuts(height: int = HEIGHT, width: int = WIDTH) -> tuple[Column, Column, Column, Column]:
    """Of a table (headers, rows): strategy, how many rows or columns are cut, how many at a time, and the starts."""
    n, m = F.size("rows"), F.size("headers")
    kind = strategy(n, m)
    long = F.when(kind == "vertical", m).otherwise(n)
    step = F.when(kind == "horizontal", height).when(kind == "vertical", width).otherwise(F.greatest(n, F.lit(1)))
    return kind, long, step, F.sequence(F.lit(0), F.greatest(long - 1, F.lit(0)), step)


def _last(first: Column, step: Column, long: Column) -> Column:
    return F.least(first + step, F.greatest(long, F.lit(1))) - 1


def slices(tables: DataFrame, *keys: str, height: int = HEIGHT, width: int = WIDTH) -> DataFrame:
    """(keys, strategy, slice, first, last): inclusive bounds from 0, rows of horizontal slices, columns of vertical ones, else the whole table's rows."""
    kind, long, step, starts = _cuts(height, width)
    return tables.select(*keys, kind.alias("strategy"), long.alias("long"), step.alias("step"), F.posexplode(starts).alias("slice", "first")).select(
        *keys, "strategy", "slice", "first", _last(F.col("first"), F.col("step"), F.col("long")).alias("last")
    )


def chunks(tables: DataFrame, id_col: str) -> DataFrame:
    """The chunks of ``marked`` tables: id, chunk_index (over the document's tables, from 0), table, chunk_type, section_title, chunk_text, first/last row and column, page_number, confidence, token_count.

    A slice takes along its own cells only; with the whole table beside every slice, memory would grow with the square of its rows.
    """
    kind, long, step, starts = _cuts()

    def piece(first: Column, i: Column) -> Column:
        last = _last(first, step, long)
        own = lambda x: F.slice(x, first + 1, last - first + 1)
        some = F.when(kind == "vertical", own(F.col("headers"))).otherwise(F.col("headers"))
        part = F.when(kind == "vertical", F.transform("rows", own)).when(kind == "horizontal", own(F.col("rows"))).otherwise(F.col("rows"))
        return F.struct(i.alias("slice"), first.alias("first"), last.alias("last"), some.alias("headers"), part.alias("rows"))

    sizes = (F.size("rows").alias("n"), F.size("headers").alias("m"))
    found = tables.select(id_col, "table", "caption", "page", "confidence", kind.alias("strategy"), *sizes, F.explode(F.transform(starts, piece)).alias("p")).select("*", "p.*").drop("p")
    across, down = F.col("strategy") == "vertical", F.col("strategy") == "horizontal"
    span = lambda word: F.concat(F.lit(f" ({word} "), (F.col("first") + 1).cast("string"), F.lit("-"), (F.col("last") + 1).cast("string"), F.lit(")"))
    title = F.concat(F.lit("Table "), F.col("table").cast("string"), F.when(down, span("Rows")).when(across, span("Columns")).otherwise(""))
    last_row, last_column = F.col("n") - 1, F.col("m") - 1
    order = Window.partitionBy(id_col).orderBy("table", "slice")
    each = found.select(
        id_col, (F.row_number().over(order) - 1).alias("chunk_index"), "table", F.when(down, "table_horizontal_slice").when(across, "table_vertical_slice").otherwise("table_complete").alias("chunk_type"), title.alias("section_title"),
        markdown(F.col("headers"), F.col("rows"), F.col("caption")).alias("chunk_text"), F.when(down, F.col("first")).otherwise(0).alias("first_row"), F.when(down, F.col("last")).otherwise(last_row).alias("last_row"),
        F.when(across, F.col("first")).otherwise(0).alias("first_column"), F.when(across, F.col("last")).otherwise(last_column).alias("last_column"), (F.col("page") + 1).alias("page_number"), "confidence",
    )
    return each.withColumn("token_count", t.token_count(F.col("chunk_text")))


def table_aware(documents: DataFrame, id_col: str, text_col: str, target: int = chunking.TARGET, least: int = chunking.LEAST) -> DataFrame:
    """All chunks of documents with marked tables: first those of the text without its tables, then the tables' own.

    (id, kind (``text`` or the table chunk's type), chunk_index (from 0 within either), section_title, chunk_text, page_numbers).
    Null texts have no chunks; tables without a data row vanish from the text like others.
    """
    plain = chunking.improved(documents.select(F.col(id_col).alias("doc_id"), without_tables(F.col(text_col)).alias("text")), target, least)
    text = plain.select(F.col("doc_id").alias(id_col), F.lit("text").alias("kind"), "chunk_index", "section_title", "chunk_text", "page_numbers")
    own = chunks(marked(documents, id_col, text_col), id_col)
    return text.unionByName(own.select(id_col, F.col("chunk_type").alias("kind"), "chunk_index", "section_title", "chunk_text", F.array("page_number").alias("page_numbers")))


def chunk_report(made: DataFrame) -> DataFrame:
    """(chunk_type, n, mean_confidence, small): chunks of each type, their mean confidence (0.5 where unknown) and how many have fewer than 50 tokens."""
    return made.where(F.startswith("chunk_type", F.lit("table_"))).groupBy("chunk_type").agg(F.count("*").alias("n"), F.avg(F.coalesce("confidence", F.lit(0.5))).alias("mean_confidence"), F.count_if(F.col("token_count") < 50).alias("small"))


def file_report(tables: DataFrame, id_col: str) -> DataFrame:
    """Per document of ``marked`` tables: how many, mean confidence, how many of each complexity and method."""
    kinds = [F.count_if(complexity(F.col("rows")) == k).alias(k) for k in ("simple", "complex", "very_complex")]
    methods = F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "m"))))
    by_method = tables.groupBy(id_col, "method").agg(F.count("*").alias("m")).groupBy(id_col).agg(methods.alias("methods"))
    return tables.groupBy(id_col).agg(F.count("*").alias("tables"), F.avg("confidence").alias("mean_confidence"), *kinds).join(by_method, id_col)


def chunk_lines(text: Column) -> Column:
    """The cells of the lines of a chunk that begin with a pipe and hold no rule."""
    return F.transform(F.filter(t.lines(text), lambda x: F.startswith(t.strip(x), F.lit("|")) & ~F.contains(x, F.lit("---"))), cells)


def value_type(v: Column) -> Column:
    """numerical, percentage, currency, date or text; signs of currency, per cent and thousands do not stop a number."""
    bare = F.regexp_replace(t.strip(v), r"[,$%]", "")
    return (
        F.when(F.rlike(bare, F.lit(r"^-?\d+(\.\d+)?$")), "numerical").when(F.contains(v, F.lit("%")), "percentage").when(F.contains(v, F.lit("$")) | F.contains(F.upper(v), F.lit("USD")), "currency")
        .when(F.rlike(v, F.lit("|".join(DATES))), "date").otherwise("text")
    )


def column_types(headers: Column, rows: Column) -> Column:
    """The type of each column by its first three data rows: the first in the order of ``value_type`` that any has, unknown without rows that long."""

    def one(i: Column) -> Column:
        found = F.transform(F.slice(F.filter(rows, lambda r: F.size(r) > i), 1, 3), lambda r: value_type(F.get(r, i)))
        out = F.lit("unknown")
        for kind in ("text", "date", "currency", "percentage", "numerical"):
            out = F.when(F.array_contains(found, kind), kind).otherwise(out)
        return out

    return F.transform(F.sequence(F.lit(0), F.size(headers) - 1), one)


def enhanced(made: DataFrame) -> DataFrame:
    """Table chunks with what retrieval asks for: headers, types, numeric columns, whether sums and comparisons make sense, a boost and a summary before the text.

    Headers are the first line of the text with a leading pipe; rows equal to them are no data.
    """
    with_rows = made.withColumn("lines", chunk_lines(F.col("chunk_text"))).withColumn("headers", F.coalesce(F.get("lines", 0), F.array().cast("array<string>")))
    data = F.filter("lines", lambda r: r != F.col("headers"))
    typed = with_rows.withColumn("types", F.when(F.size("headers") > 0, column_types(F.col("headers"), data)).otherwise(F.array().cast("array<string>")))
    numeric = F.transform(F.filter(F.arrays_zip("headers", "types"), lambda z: z["types"].isin("numerical", "percentage", "currency")), lambda z: z["headers"])
    out = typed.withColumn("numerical_columns", numeric)
    parts = F.array_compact(F.array(
        F.when(F.size("headers") > 0, F.concat(F.lit("Table with columns: "), F.array_join("headers", ", "))),
        F.when(F.size("numerical_columns") > 0, F.concat(F.lit("Numerical data in: "), F.array_join("numerical_columns", ", "))),
        F.when(F.size("lines") > 1, F.concat(F.lit("Contains "), (F.size("lines") - 1).cast("string"), F.lit(" data rows"))),
    ))
    out = out.withColumn("aggregation_capable", F.size("numerical_columns") > 0).withColumn("comparison_capable", F.size("headers") > 1).withColumn("summary", F.array_join(parts, ". "))
    return out.withColumn("boost", boost(F.col("chunk_type") == "table_complete", F.col("confidence"), F.lit(False))).withColumn("enhanced_text", F.concat("summary", F.lit("\n\n"), F.col("chunk_text"))).drop("lines")


def question(query: Column) -> Column:
    """What a question asks of tables: aggregation, comparison, column names (one after the other, pattern by pattern) and the table it names first."""
    low = F.lower(query)
    names = F.flatten(F.array(*[F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in COLUMN_NAMES]))
    any_of = lambda patterns: F.rlike(low, F.lit("|".join(patterns)))
    return F.struct(any_of(AGGREGATIONS).alias("aggregation"), any_of(COMPARISONS).alias("comparison"), names.alias("columns"), t.first_group(low, r"table\s+(\w+)").alias("target"))


def prioritised(pairs: DataFrame) -> DataFrame:
    """Priority of chunks for questions, from ``enhanced`` chunks with a ``question`` column: 1 for plain text; tables by fitting abilities, named columns and boost."""
    q = F.col("question")
    common = F.size(F.array_intersect(q["columns"], F.col("headers")))
    score = F.when(q["aggregation"] & F.col("aggregation_capable"), 1.5).otherwise(1.0) * F.when(q["comparison"] & F.col("comparison_capable"), 1.3).otherwise(1.0) * (1 + common * F.lit(0.1)) * F.col("boost")
    return pairs.withColumn("priority", F.when(F.startswith("chunk_type", F.lit("table_")), score).otherwise(1.0))


def prompt(ranked: DataFrame, by: str, k: int = 3) -> DataFrame:
    """(by, context): the ``k`` first tables (rank, summary, chunk_text, confidence) of each question as prompt text; low confidence is told."""
    low = F.coalesce("confidence", F.lit(0.0))
    note = F.when(low < 0.7, F.concat(F.lit("Note: This table has lower confidence ("), F.format_string("%.2f", low), F.lit(")")))
    lines = F.array_compact(F.array(
        F.concat(F.lit("\nTable "), F.col("rank").cast("string"), F.lit(":")), F.when(F.length("summary") > 0, F.concat(F.lit("Summary: "), F.col("summary"))), F.col("chunk_text"), note,
    ))
    each = ranked.where(F.col("rank") <= k).select(by, F.struct("rank", F.array_join(lines, "\n").alias("text")).alias("x"))
    parts = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"])
    return each.groupBy(by).agg(F.concat(F.lit("Here are relevant tables from the document:\n"), F.array_join(parts, "\n")).alias("context"))


def answer_check(response: Column, texts: Column) -> Column:
    """Whether an answer speaks of tables, whether one of its first three numbers stands in a table text, whether it calculates, and a confidence."""
    low = F.lower(response)
    numbers = F.regexp_extract_all(response, F.lit(r"\b\d+\.?\d*\b"), F.lit(0))
    refers = F.rlike(low, F.lit("|".join(REFERENCES)))
    seen = F.exists(F.slice(numbers, 1, 3), lambda n: F.exists(texts, lambda x: F.contains(x, n)))
    accuracy = F.when(F.size(numbers) == 0, "unknown").when(seen, "verified_in_tables").otherwise("needs_verification")
    score = 0.5 + F.when(seen, 0.3).otherwise(0.0) + F.when(refers, 0.2).otherwise(0.0)
    return F.struct(refers.alias("refers"), accuracy.alias("accuracy"), t.any_of(low, CALCULATIONS).alias("calculates"), score.alias("confidence"))


def complexity(rows: Column) -> Column:
    n = F.size(rows)
    return F.when(n > 10, "very_complex").when((n > 5) & F.exists(rows, lambda r: F.size(r) > 5), "complex").otherwise("simple")


def layout_confidence(rows: Column) -> Column:
    """.9 where all rows have the first one's number of cells, .7 where they differ by one at most, else .5."""
    first = F.size(F.get(rows, 0))
    return F.when(F.forall(rows, lambda r: F.size(r) == first), 0.9).when(F.forall(rows, lambda r: F.abs(F.size(r) - first) <= 1), 0.7).otherwise(0.5)


def quality(headers: Column, rows: Column) -> Column:
    """1 without the share of empty cells and a tenth for each ragged row; not below 0."""
    flat = F.flatten(rows)
    empty = F.coalesce(F.try_divide(F.size(F.filter(flat, lambda v: v == "")).cast("double"), F.size(flat)), F.lit(0.0))
    return F.greatest(F.lit(0.0), 1 - empty - F.size(F.filter(rows, lambda r: F.size(r) != F.size(headers))) * 0.1)


def boost(complete: Column, confidence: Column, aggregates: Column) -> Column:
    """Retrieval boost of a table chunk, at most 2."""
    return F.least(F.when(complete, 1.2).otherwise(1.0) * (F.coalesce(confidence, F.lit(0.5)) + 0.5) * F.when(aggregates, 1.3).otherwise(1.0), F.lit(2.0))


def distinct_boxes(boxes: DataFrame, page: str, most: float = 0.5) -> DataFrame:
    """Of the boxes (x0, y0, x1, y1, confidence, id) of a page those that overlap no surer kept one by more than ``most`` of the smaller area, surest first.

    A fold over the boxes of one page (tables of a page are few); ties in confidence go to the smaller id.
    """
    box = F.struct((-F.col("confidence")).alias("c"), F.col("id"), "x0", "y0", "x1", "y1")

    def overlap(a: Column, b: Column) -> Column:
        wide, high = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
        area = lambda z: (z["x1"] - z["x0"]) * (z["y1"] - z["y0"])
        return F.when((wide > 0) & (high > 0), wide * high / F.least(area(a), area(b))).otherwise(0.0)

    grouped = boxes.groupBy(page).agg(F.array_sort(F.collect_list(box)).alias("all"))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda done, b: F.when(F.exists(done, lambda a: overlap(a, b) > most), done).otherwise(F.array_append(done, b)))
    return grouped.select(page, F.explode(kept).alias("b")).select(page, F.col("b.id").alias("id"))
