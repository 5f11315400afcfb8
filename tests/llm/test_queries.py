"""The registered queries over whole tables against plain re-statements."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tests.llm import brute


def run(spark, sf_dir, name):
    return [r.asDict() for r in entry.queries()[name](spark, sf_dir).collect()]


def held(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_op1(spark, sf_dir):
    got = defaultdict(list)
    for r in sorted(run(spark, sf_dir, "op1_top_k"), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    usable = {r["vec_id"]: [math.floor(256 * x) for x in r["embedding"]] for r in brute.rows(sf_dir, "embeddings") if r["embedding"] and all(x is not None and math.isfinite(x) for x in r["embedding"])}
    ids = sorted(usable)
    m = np.array([usable[i] for i in ids])
    for q in (i for i in ids if i % 50 == 0):
        scores = m @ np.array(usable[q])
        best = sorted((-int(s), i) for s, i in zip(scores, ids, strict=True) if i != q)[:5]
        assert got.pop(q) == [(k + 1, -s, i) for k, (s, i) in enumerate(best)]
    assert not got


def test_op2(spark, sf_dir):
    got = {r["conv_id"]: r for r in run(spark, sf_dir, "op2_chat_format")}
    said = defaultdict(list)
    for r in [*brute.rows(sf_dir, "conversations"), *({"conv_id": -7, "turn": t, "role": x, "text": "</s>[INST] ok [/INST]"} for t, x in ((0, "user"), (1, "assistant")))]:
        said[r["conv_id"]].append(r)
    assert got.keys() == said.keys()
    for key, turns in said.items():
        turns.sort(key=lambda r: r["turn"])
        loss = "".join(r["text"] or "" for r in turns if r["role"] == "assistant")
        assert got[key]["n_turns"] == len(turns)
        assert got[key]["turns_sha256"] == brute.sha("".join(f"{r['role']}\n{r['text'] or ''}\n" for r in turns))
        assert (got[key]["loss_chars"], got[key]["loss_sha256"]) == (len(loss), brute.sha(loss))


def test_chats_urls_and_searches_equal_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in ("conversations", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    for name in ("op1_top_k", "op2_chat_format", "op3_url_filter"):
        found = con.execute(entry.oracle_sql()[name])
        columns = [c[0] for c in found.description]
        theirs = Counter(tuple(r) for r in found.fetchall())
        assert Counter(tuple(r[c] for c in columns) for r in run(spark, sf_dir, name)) == theirs, name


def test_op3(spark, sf_dir):
    rules = {("com", "/"): "allow", ("example.com", "/en/"): "block", ("www.example.com", "/en/"): "allow", ("net", "/es/"): "block", ("net", "/fr/"): "block"}
    got = {r["page_id"]: r for r in run(spark, sf_dir, "op3_url_filter")}
    for page in brute.rows(sf_dir, "pages"):
        rest = (page["url"] or "").partition("://")[2]
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = host.translate(brute.ASCII)
        fits = [(len(h + p), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = got.pop(page["page_id"])
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (max(fits)[1] if fits else None)
        assert r["verdict"] == (max(fits)[2] if fits else "allow")
    assert not got


def test_op4(spark, sf_dir):
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    got = {r["doc_id"]: r for r in run(spark, sf_dir, "op4_license_scan")}
    more = 0
    for d in brute.rows(sf_dir, "documents"):
        w, r = brute.words(d["text"]), got.pop(d["doc_id"])
        places = [(i, label) for p, label in phrases.items() for i in range(len(w) - len(p) + 1) if tuple(w[i : i + len(p)]) == p]
        starts, labels = [i for i, _ in places], {x for _, x in places}
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted(labels))
        assert labels <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
        more += r["labels"] != r["base_labels"]
    assert not got and more


def test_op5(spark, sf_dir):
    sets = {d["doc_id"]: brute.shingles(d["text"], 2) for d in brute.rows(sf_dir, "documents")}
    component = brute.components(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in run(spark, sf_dir, "op5_near_duplicates")}
    assert got == {k: (len(s), component[k], component[k] == k) for k, s in sets.items()}


def test_op6(spark, sf_dir):
    items = [(r["item_id"], r["text"]) for r in brute.rows(sf_dir, "benchmark")]
    got = {r["doc_id"]: r for r in run(spark, sf_dir, "op6_decontamination")}
    for d in brute.rows(sf_dir, "documents"):
        n, hit, found = brute.contamination(d["text"], items)
        assert got.pop(d["doc_id"]) == {"doc_id": d["doc_id"], "n_words": n, "n_hit": hit, "n_items": len(found), "items_sha256": brute.sha(",".join(found)), "contaminated": hit > 0}
    assert not got


def classifier(spark, sf_dir, name, label, threshold):
    got = {r["doc_id"]: r for r in run(spark, sf_dir, name)}
    assert got.keys() == {d["doc_id"] for d in brute.rows(sf_dir, "documents")}
    for k, r in got.items():
        assert r["held_out"] == held(k) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
    known = [(got[r["doc_id"]]["score"], r[label]) for r in brute.rows(sf_dir, "labels") if held(r["doc_id"]) and r["doc_id"] in got]
    return brute.auc(known), sum((s >= threshold) == bool(y) for s, y in known) / len(known)


def test_op7(spark, sf_large):
    area, right = classifier(spark, sf_large, "op7_toxicity", "toxic", 0.5)
    assert area > 0.94 and right > 0.95, (area, right)


def test_op10(spark, sf_large):
    area, right = classifier(spark, sf_large, "op10_quality", "quality", 0.3)
    assert area > 0.99 and right > 0.98, (area, right)


def check_pieces(pieces, docs):
    """The contract of packing; returns the share of padding."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    texts = Counter(d["doc_id"] for d in docs)
    assert max(texts.values()) == 1 and by_doc.keys() == texts.keys()
    for d in docs:
        ids = np.array([*library.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(by_doc[d["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] > 0
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : at].tobytes())
        assert at == len(ids)
    padding = total = 0
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
        total += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding / total


def test_op8(spark, sf_dir):
    assert check_pieces(run(spark, sf_dir, "op8_packing"), brute.rows(sf_dir, "documents")) < 0.02


def test_op9(spark, sf_dir):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in run(spark, sf_dir, "op9_token_counts")}
    for d in brute.rows(sf_dir, "documents"):
        text = d["text"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert got.pop(d["doc_id"]) == {"doc_id": d["doc_id"], "n_bytes": len(text.encode()), "n_tokens": n, "over_limit": n > 2048}
    assert not got
