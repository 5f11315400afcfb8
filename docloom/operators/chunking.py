"""Chunkers: DataFrame of (doc_id, text) to DataFrame of (doc_id, chunk_index, chunk_text, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as t

# Window sizes and overlaps in words, type to strategy.
FIXED, SECTION, SEMANTIC = (1000, 200), (1500, 100), (1200, 150)
STRATEGY = {
    "legal": "clause_based", "technical": "procedure_based", "academic": "section_based", "business": "semantic_based", "medical": "procedure_based",
    "scientific": "section_based", "government": "section_based", "general": "fixed_size",
}
CLAUSE_START = r"^((SECTION|ARTICLE)\s+\d+[.:]|CLAUSE\s+\d+[.:]|\d+\.\s+)"
STEP_START = r"^((Step|Procedure|Method)\s+\d+[.:]|\d+\.\s+)"
SPLIT_HEADERS = [r"\n\s*[A-Z][A-Z\s]{10,}\n", r"\n\s*\d+\.\s+[A-Z]", r"\n\s*[A-Z][^.!?]{5,50}\n"]
TARGET, LEAST = 512, 128
ORDER = ("fixed_size", "section_based", "clause_based", "procedure_based", "semantic_based", "hybrid")


def windows(words: Column, size: int, overlap: int) -> Column:
    """Array of (position, chunk words) of windows that start every ``size - overlap`` words."""
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("position"), F.slice(words, s + 1, size).alias("words")))


def fixed(docs: DataFrame, size: int = FIXED[0], overlap: int = FIXED[1], keep: tuple[str, ...] = ()) -> DataFrame:
    """Fixed windows: doc_id, chunk_index, chunk_text, position (start word), word_count, overlap_size, and the columns of ``docs`` to ``keep``."""
    each = docs.select("doc_id", *keep, t.words(F.col("text")).alias("w")).select("doc_id", *keep, F.posexplode(windows(F.col("w"), size, overlap)).alias("chunk_index", "c"))
    return each.select(
        "doc_id", "chunk_index", F.array_join("c.words", " ").alias("chunk_text"), "c.position", F.size("c.words").alias("word_count"), F.when(F.col("chunk_index") == 0, 0).otherwise(overlap).alias("overlap_size"), *keep
    )


def sections(chunks: DataFrame) -> DataFrame:
    """Runs of equal titles over (doc_id, chunk_index, chunk_text, section_title), joined by blanks; empty runs drop out."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    change = (~F.col("section_title").eqNullSafe(F.lag("section_title").over(w))) | F.lag("chunk_index").over(w).isNull()
    runs = chunks.withColumn("change", change.cast("int")).withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))), lambda x: x["chunk_text"]), " ")
    joined = runs.groupBy("doc_id", "run").agg(F.first("section_title").alias("section_title"), text.alias("chunk_text")).where(t.strip(F.col("chunk_text")) != "")
    return joined.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("run")) - 1).alias("chunk_index"), "section_title", "chunk_text")


def _flagged(docs: DataFrame, start: str, kind, title: str) -> DataFrame:
    """Lines grouped from each starting line on; lines before the first start are a group of their own.

    Inside the row: no line is shuffled.  The places of the starts are found first, groups are slices between them, so
    work grows with the number of lines.
    """
    lines = F.filter(F.transform(t.lines(F.col("text")), t.strip), lambda x: x != "")
    rows = docs.select("doc_id", lines.alias("l")).where(F.size("l") > 0)

    def groups_of(l: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(l) - 1), lambda i: (i == 0) | F.rlike(F.get(l, i), F.lit(start)))
        return t.let(starts, lambda s: F.transform(s, lambda a, k: F.slice(l, a + 1, F.coalesce(F.get(s, k + 1), F.size(l)) - a)))

    groups = t.let(F.col("l"), groups_of)
    each = rows.select("doc_id", F.posexplode(groups).alias("chunk_index", "g"))
    text = each.select("doc_id", "chunk_index", F.array_join("g", " ").alias("chunk_text"))
    return text.select("doc_id", "chunk_index", "chunk_text", F.concat(F.lit(title), (F.col("chunk_index") + 1).cast("string")).alias("section_title"), kind(F.col("chunk_text")).alias("kind"))


def clauses(docs: DataFrame) -> DataFrame:
    """Legal clauses with their type (``kind``)."""
    return _flagged(docs, CLAUSE_START, t.clause_type, "Clause ")


def steps(docs: DataFrame) -> DataFrame:
    """Procedure steps with their type (``kind``)."""
    return _flagged(docs, STEP_START, t.step_type, "Step ")


def semantic(docs: DataFrame, separator: str = "\n\n", size: int | None = SEMANTIC[0], overlap: int = SEMANTIC[1]) -> DataFrame:
    """Paragraphs, numbered with gaps where empty ones drop out; those longer than ``size`` words (None: none are) in windows: paragraph, part, chunk_text, title."""
    paras = docs.select("doc_id", F.posexplode(F.split("text", separator)).alias("paragraph", "p")).select("doc_id", "paragraph", t.strip(F.col("p")).alias("p")).where("p != ''")
    if size is None:
        number = F.concat(F.lit("Paragraph "), (F.col("paragraph") + 1).cast("string"))
        return paras.select("doc_id", "paragraph", F.lit(0).alias("part"), F.col("p").alias("chunk_text"), number.alias("title"))
    words = t.words(F.col("p"))
    pieces = F.when(F.size(words) > size, F.transform(windows(words, size, overlap), lambda x: F.array_join(x["words"], " "))).otherwise(F.array("p"))
    each = paras.select("doc_id", "paragraph", (F.size(words) > size).alias("long"), F.posexplode(pieces).alias("part", "chunk_text"))
    number = F.concat(F.lit("Paragraph "), (F.col("paragraph") + 1).cast("string"))
    return each.select("doc_id", "paragraph", "part", "chunk_text", F.when(F.col("long"), F.concat(number, F.lit("."), (F.col("part") + 1).cast("string"))).otherwise(number).alias("title"))


def packed(pieces: Column, limit: int, joint: str) -> Column:
    """Greedy packing of an array of strings: as many as fit into ``limit`` words, in order; a longer piece stands alone.

    The fold keeps only where chunks start and end (pieces without words before the first one drop out); texts are joined once.
    """
    cut = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))
    start = F.struct(F.array_remove(F.array(cut), cut).alias("done"), F.lit(0).alias("a"), F.lit(0).alias("i"), F.lit(0).alias("n"))

    def step(s: Column, n: Column) -> Column:
        fits = s["n"] + n <= limit
        return F.struct(
            F.when(fits | (s["n"] == 0), s["done"]).otherwise(F.array_append(s["done"], F.struct(s["a"].alias("a"), s["i"].alias("b")))).alias("done"),
            F.when((s["n"] == 0) | ~fits, s["i"]).otherwise(s["a"]).alias("a"), (s["i"] + 1).alias("i"), F.when(fits, s["n"] + n).otherwise(n).alias("n"),
        )

    def join(p: Column) -> Column:
        cuts = F.aggregate(F.transform(p, t.token_count), start, step, lambda s: F.when(s["n"] > 0, F.array_append(s["done"], F.struct(s["a"].alias("a"), s["i"].alias("b")))).otherwise(s["done"]))
        return F.transform(cuts, lambda c: F.array_join(F.slice(p, c["a"] + 1, c["b"] - c["a"]), joint))

    return t.let(pieces, join)


def section_split(c: Column) -> Column:
    """Pieces of a text at page markers, then at the first kind of header that splits a page."""
    def headers(x: Column) -> Column:
        out = F.array(x)
        for p in reversed(SPLIT_HEADERS):
            out = F.when(F.size(F.split(x, p)) > 1, F.split(x, p)).otherwise(out)
        return out

    kept = lambda a: F.filter(a, lambda x: t.strip(x) != "")
    found = kept(F.flatten(F.transform(kept(F.split(c, r"(?i)---\s*Page\s+\d+\s*---")), headers)))
    return F.when(F.size(found) > 0, found).otherwise(kept(F.split(c, "\n\n")))


def improved(docs: DataFrame, target: int = TARGET, least: int = LEAST) -> DataFrame:
    """Sections, paragraphs packed to ``target`` words (longer ones by sentences), chunks below ``least`` dropped; numbered after that, with page and title."""
    def inside(section: Column) -> Column:
        paras = F.filter(F.transform(F.split(section, "\n\n"), t.strip), lambda p: p != "")
        split = F.flatten(F.transform(paras, lambda p: F.when(t.token_count(p) > target, F.filter(F.transform(t.parts(p), t.strip), lambda s: s != "")).otherwise(F.array(p))))
        return packed(split, target, "\n\n")

    chunks = F.flatten(F.transform(section_split(F.col("text")), inside))
    kept = F.filter(chunks, lambda x: t.token_count(x) >= least)
    each = docs.select("doc_id", F.posexplode(kept).alias("chunk_index", "chunk_text"))
    return each.select("doc_id", "chunk_index", "chunk_text", t.token_count(F.col("chunk_text")).alias("token_count"), t.pages_light(F.col("chunk_text")).alias("page_numbers"), t.title_light(F.col("chunk_text")).alias("section_title"))


def token_limited(c: Column, limit: int = 3000) -> Column:
    """A text within the limit as it is; else its paragraphs (long ones by sentences, a text without paragraphs by words) packed to the limit."""
    paras = F.filter(F.transform(F.split(c, "\n\n"), t.strip), lambda p: p != "")
    by_sentence = F.flatten(F.transform(paras, lambda p: F.when(t.token_count(p) > limit, F.filter(F.split(p, r"\. "), lambda s: s != "")).otherwise(F.array(p))))
    by_word = F.transform(windows(t.words(c), limit, 0), lambda x: F.array_join(x["words"], " "))
    return F.when(t.token_count(c) <= limit, F.array(c)).when(F.size(F.split(c, "\n\n")) > 1, packed(by_sentence, limit, " ")).otherwise(by_word)


def strategy(kind: Column, patterns: Column) -> Column:
    """Strategy of a document type, changed by structure patterns (array of (pattern, confidence), most confident first)."""
    base = F.coalesce(F.create_map(*[F.lit(x) for kv in STRATEGY.items() for x in kv])[kind], F.lit("fixed_size"))

    def step(s: Column, p: Column) -> Column:
        sure = p["confidence"] > 0.7
        return F.when(sure & (p["pattern"] == "procedural") & (s != "procedure_based"), F.lit("hybrid")).when(sure & (p["pattern"] == "section_hierarchy"), F.lit("section_based")).otherwise(s)

    return F.aggregate(patterns, base, step)


def titled_paragraphs(docs: DataFrame, separator: str = "\n\n") -> DataFrame:
    """Paragraphs with the title of the last heading among them (null before the first): doc_id, chunk_index, chunk_text, section_title."""
    paras = semantic(docs, separator, None).select("doc_id", F.col("paragraph").alias("chunk_index"), "chunk_text")
    seen = Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    title = F.when(t.is_heading(F.col("chunk_text"), 1), t.heading_title(F.col("chunk_text")))
    return paras.withColumn("section_title", F.last(title, ignorenulls=True).over(seen))


def by_strategy(docs: DataFrame, size: int = 100, overlap: int = 20, separator: str = "\n") -> DataFrame:
    """The chunks of every document under all six strategies: doc_id, strategy, chunk_index, chunk_text, boundary (whether the chunk ends at a border of the strategy's kind)."""
    def cut(df: DataFrame, name: str, boundary: bool) -> DataFrame:
        return df.select("doc_id", F.lit(name).alias("strategy"), F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_text", F.lit(boundary).alias("boundary"))

    numbered = semantic(docs, separator).withColumn("chunk_index", F.col("paragraph") * F.lit(1 << 32) + F.col("part"))
    made = {
        "fixed_size": cut(fixed(docs, size, overlap), "fixed_size", False), "section_based": cut(sections(titled_paragraphs(docs, separator)), "section_based", True),
        "clause_based": cut(clauses(docs), "clause_based", True), "procedure_based": cut(steps(docs), "procedure_based", True), "semantic_based": cut(numbered, "semantic_based", True),
    }
    out = reduce(DataFrame.unionByName, made.values())
    return out.unionByName(hybrid(out, docs, size, overlap, separator))


def hybrid(cuts: DataFrame, docs: DataFrame, size: int = 100, overlap: int = 20, separator: str = "\n") -> DataFrame:
    """The hybrid strategy, from ``by_strategy`` rows: a document's sections if there are several, else its semantic chunks if there are several, else its fixed windows."""
    choice = _counts(docs, size, overlap, separator).select("doc_id", _hybrid_of().alias("strategy"))
    return cuts.join(choice, ["doc_id", "strategy"]).withColumn("strategy", F.lit("hybrid")).select(cuts.columns)


def _hybrid_of() -> Column:
    return F.when(F.size("section_based") > 1, "section_based").when(F.size("semantic_based") > 1, "semantic_based").otherwise("fixed_size")


def _counts(docs: DataFrame, size: int, overlap: int, separator: str) -> DataFrame:
    """(doc_id, an array for each plain strategy): how many words each of its chunks has.

    Inside the row, from the words of every line and paragraph and the places where a chunk begins: no text is cut or shuffled.
    """
    full = lambda a: F.filter(F.transform(a, t.strip), lambda x: x != "")
    begins = lambda a, found: F.filter(F.transform(a, lambda x, i: F.when((i == 0) | found(x), i)), lambda i: i.isNotNull())
    title = lambda x: F.when(t.is_heading(x, 1), t.heading_title(x))
    rows = docs.select("doc_id", full(t.lines(F.col("text"))).alias("l"), *([] if separator == "\n" else [full(F.split("text", separator)).alias("p")])).where(F.size("l") > 0)
    paras = "l" if separator == "\n" else "p"
    heads = F.filter(F.transform(F.col(paras), lambda x, i: F.struct(i.alias("i"), title(x).alias("title"))), lambda h: h["title"].isNotNull())
    told = rows.select(
        "doc_id", F.transform("l", t.token_count).alias("n"), begins(F.col("l"), lambda x: F.rlike(x, F.lit(CLAUSE_START))).alias("clauses"), begins(F.col("l"), lambda x: F.rlike(x, F.lit(STEP_START))).alias("steps"),
        heads.alias("heads"), *([] if separator == "\n" else [F.transform("p", t.token_count).alias("pn")]),
    )
    n, pn, none = F.col("n"), F.col("n" if separator == "\n" else "pn"), F.array().cast("array<int>")
    # a heading that repeats the last one begins no run
    changes = F.filter("heads", lambda h, k: (k == 0) | (h["title"] != F.get(F.col("heads"), k - 1)["title"]))
    runs = F.array_union(F.when(F.size(pn) > 0, F.array(F.lit(0))).otherwise(none), F.transform(changes, lambda h: h["i"]))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    sums = lambda a, starts: F.transform(starts, lambda b, k: total(F.slice(a, b + 1, F.coalesce(F.get(starts, k + 1), F.size(a)) - b)))

    def cut(words: Column, size: int, overlap: int) -> Column:
        return F.transform(F.sequence(F.lit(0), words - 1, F.lit(size - overlap)), lambda s: F.least(F.lit(size), words - s))

    semantic = F.flatten(F.transform(pn, lambda x: F.when(x > SEMANTIC[0], cut(x, *SEMANTIC)).otherwise(F.array(x))))
    placed = told.select("doc_id", n.alias("n"), pn.alias("pn"), "clauses", "steps", runs.alias("runs"), total(n).alias("words"))
    return placed.select(
        "doc_id", cut(F.col("words"), size, overlap).alias("fixed_size"), sums(F.col("pn"), F.col("runs")).alias("section_based"), sums(n, F.col("clauses")).alias("clause_based"),
        sums(n, F.col("steps")).alias("procedure_based"), semantic.alias("semantic_based"),
    )


def word_counts(docs: DataFrame, size: int = 100, overlap: int = 20, separator: str = "\n") -> DataFrame:
    """(doc_id, strategy, word_count, boundary): the words of every chunk of ``by_strategy``, without its texts, in one pass over the documents."""
    counts = _counts(docs, size, overlap, separator)
    hybrid_n = F.create_map(*[x for k in ("section_based", "semantic_based", "fixed_size") for x in (F.lit(k), F.col(k))])[_hybrid_of()]
    each = [(F.lit(k), F.col(k), F.lit(k != "fixed_size")) for k in ORDER[:-1]] + [(F.lit("hybrid"), hybrid_n, _hybrid_of() != "fixed_size")]
    cuts = counts.select("doc_id", F.inline(F.array(*[F.struct(k.alias("strategy"), c.alias("counts"), b.alias("boundary")) for k, c, b in each])))
    return cuts.select("doc_id", "strategy", F.explode("counts").alias("word_count"), "boundary")


def quality(chunks: DataFrame, boundary: str = "boundary", by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document (or ``by``) of (doc_id, word_count, boundary): average words, variation, boundary share, overall, advice."""
    m = chunks.groupBy(*by).agg(F.count("*").alias("chunks"), F.avg("word_count").alias("avg_words"), F.stddev_pop("word_count").alias("sd"), F.avg(F.col(boundary).cast("double")).alias("boundary_share"))
    cv = F.when((F.col("chunks") < 2) | (F.col("avg_words") == 0), 0.0).otherwise(F.col("sd") / F.col("avg_words"))
    size = F.least(F.col("avg_words") / 800, F.lit(1.0))
    m = m.withColumn("variation", cv).withColumn("overall", 0.3 * size + 0.2 * F.greatest(F.lit(0.0), 1 - F.col("variation")) + 0.3 * F.col("boundary_share") + 0.14)
    advice = [("overall", F.col("overall") < 0.6), ("boundaries", F.col("boundary_share") < 0.5), ("smaller chunks", F.col("avg_words") > 1200), ("larger chunks", F.col("avg_words") < 400)]
    return m.withColumn("advice", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in advice]))).drop("sd")


def compare(docs: DataFrame, size: int = 100, overlap: int = 20, separator: str = "\n") -> DataFrame:
    """All six strategies per document with overall quality and suitability, and ``place`` by quality (ties in the order of ``ORDER``).

    Suitability is the share of chunks at a border of the strategy's own kind; of fixed and hybrid chunks the mean length in 800 words, at most 1.
    """
    scored = quality(word_counts(docs, size, overlap, separator), by=("doc_id", "strategy"))
    suits = F.when(F.col("strategy").isin("fixed_size", "hybrid"), F.least(F.col("avg_words") / 800, F.lit(1.0))).otherwise(F.col("boundary_share"))
    ord_ = F.create_map(*[F.lit(x) for i, k in enumerate(ORDER) for x in (k, i)])[F.col("strategy")]
    best = Window.partitionBy("doc_id").orderBy(F.desc(F.round("overall", 9)), ord_)
    return scored.select("doc_id", "strategy", "chunks", "overall", suits.alias("suitability"), F.row_number().over(best).alias("place"))
