"""Box groups and merged tables on small inputs."""

from __future__ import annotations

from docloom.operators import layout, tables

B = "page long, id long, x0 double, y0 double, x1 double, y1 double"
T = "doc_id long, table int, headers array<string>, rows array<array<string>>, caption string, page int, method string, confidence double"


def test_groups_rows_and_tables(spark):
    boxes = [
        (1, 1, 0, 0, 40, 10), (1, 2, 60, 1, 90, 11), (1, 3, 0, 8, 40, 18), (1, 4, 60, 9, 90, 19),  # two rows of two
        (1, 5, 0, 60, 40, 70), (1, 6, 0.4, 61, 40, 71),  # one left edge only
        (1, 7, 0, 200, 10, 210),  # alone
        (2, 1, 0, None, 1, 1),
    ]
    rows = [tuple(float(x) if i > 1 and x is not None else x for i, x in enumerate(b)) for b in boxes]
    got = {(r["page"], r["id"]): (r["box_group"], r["row"], r["column"], r["is_table"]) for r in layout.box_groups(spark.createDataFrame(rows, B)).collect()}
    assert [got[1, k] for k in range(1, 5)] == [(0, 0, 0, True), (0, 0, 1, True), (0, 1, 0, True), (0, 1, 1, True)]
    assert got[1, 5] == (1, 0, 0, False) and got[1, 6] == (1, 0, 1, False) and got[1, 7] == (2, 0, 0, False) and got[2, 1] == (0, 0, 0, False)
    assert layout.box_groups(spark.createDataFrame([], B)).count() == 0


def plain(text, found):
    """All edits from places in the original text, in order."""
    edits = []
    for t in found:
        at = next((text.find(h) for h in (t[2] or [])[:3] if h and len(h) > 3 and h in text), -1)
        body = "| " + " | ".join(t[2]) + " |\n|" + "|".join(" --- " for _ in t[2]) + "|\n" + "\n".join("| " + " | ".join(r) + " |" for r in t[3]) + (f"\n*Table: {t[4]}*" if t[4] else "") if t[3] else ""
        block = f"\n\n<!-- TABLE_START: Table {t[1]} -->\n**Table {t[1]}**" + (f": {t[4]}" if t[4] else "") + f"\n*Extracted with {t[6]} (confidence: {t[7]:.2f})*\n\n{body}\n<!-- TABLE_END: Table {t[1]} -->\n"
        marker = f"--- Page {t[5] + 1} ---"
        if at >= 0:
            ends = [p for m in layout.SECTION_ENDS if (p := text.find(m, at + 1)) >= 0]
            edits.append((at, t[1], min(ends, default=len(text)), block))
        elif marker in text:
            p = text.find(marker) + len(marker)
            edits.append((p, t[1], p, "\n\n" + block))
        else:
            edits.append((len(text), t[1], len(text), "\n\n" + block))
    out, used = "", 0
    for start, _, end, put in sorted(edits):
        out += text[used : max(start, used)] + put
        used = max(used, end)
    return out + text[used:]


def test_tables_go_to_their_places(spark):
    text = "Intro\n--- Page 1 ---\nbefore\nRegion Sales\nNorth 1\n\n## Next\nmore Costs here\n\n# End\n--- Page 3 ---\nlast"
    found = [
        (1, 1, ["Region", "Sales"], [["North", "1"]], "of sales", 0, "text_based", 0.7),
        (1, 2, ["x", "Sales", "Region"], [["a", "b"]], None, 0, "camelot", 0.925),  # inside what the first replaces
        (1, 3, ["Costs"], [["9"]], "", 1, "text_based", 1.0),
        (1, 4, ["abc"], [["1"]], None, 2, "m", 0.5),  # after its page's marker
        (1, 5, ["nope"], [], None, 8, "m", 0.5),  # appended, no rows
        (3, 1, ["head"], [["1"]], None, 0, "m", 0.5),  # the text is null
        (9, 1, ["head"], [["1"]], None, 0, "m", 0.5),  # no such document
    ]
    docs = spark.createDataFrame([(1, text, "x"), (2, "no tables", "x"), (3, None, "x"), (4, None, "x")], "doc_id long, text string, merged string").drop("merged")
    got = {r["doc_id"]: r["merged"] for r in layout.merge_tables(docs, spark.createDataFrame(found, T)).collect()}
    assert got == {1: plain(text, found[:5]), 2: "no tables", 3: plain("", [found[5]]), 4: None}
    back = tables.marked(spark.createDataFrame([(1, got[1])], "doc_id long, text string"), "doc_id", "text").collect()
    assert [(r["headers"], r["confidence"]) for r in back][0] == (["Region", "Sales"], 0.7) and len(back) == 4  # the one without rows is no table
    assert layout.merge_tables(docs.limit(0), spark.createDataFrame([], T)).count() == 0
