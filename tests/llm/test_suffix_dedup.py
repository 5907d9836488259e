"""Exact substrings against a plain table of windows."""

from __future__ import annotations

import hashlib
import random

from larkspur.llm import suffix_dedup


def plain(texts, least=50):
    first, out = {}, {}
    for d in sorted(texts):
        raw = (texts[d] or "").encode()
        for i in range(len(raw) - least + 1):
            first.setdefault(raw[i : i + least], d)
    for d in texts:
        raw = (texts[d] or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - least + 1):
            if first[raw[i : i + least]] < d:
                gone[i : i + least] = [True] * least
        spans = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out


def made(prose, n, seed):
    rng = random.Random(seed)
    passages = [prose(rng.randrange(8, 40), 1000 + i) for i in range(6)] + ["é" * 40 + "x" * 30, "ab" * 60, "a" * 200, "línea común " * 8]
    texts = {}
    for d in rng.sample(range(10 * n), n):
        parts = [prose(rng.randrange(1, 30), rng.randrange(10**6)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts.insert(rng.randrange(4), p[a : a + rng.randrange(20, len(p))])
        texts[d] = rng.choice([" ", "", "\n"]).join(parts) if rng.random() > 0.1 else rng.choice(["", None, "short", passages[0]])
    return texts


def check(spark, texts, **options):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = suffix_dedup.duplicate_bytes(df, **options).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got} == plain(texts)


def test_against_windows_in_one_block(spark, prose):
    check(spark, made(prose, 60, 1))


def test_against_windows_in_many_blocks(spark, prose):
    for seed in (2, 3):
        check(spark, made(prose, 90, seed), block_bytes=3000)


def test_merged_transforms_find_what_sorting_finds():
    import numpy as np

    rng = random.Random(4)
    base = bytes(rng.randrange(97, 100) for _ in range(400))
    strings = [base[a : a + rng.randrange(60, 120)] for a in rng.sample(range(280), 9)]
    doc = [rng.randrange(5) for _ in strings]
    first = {}
    for s, d in zip(strings, doc, strict=True):
        for i in range(len(s) - 49):
            first[s[i : i + 50]] = min(d, first.get(s[i : i + 50], d))
    want = {(k, i) for k, (s, d) in enumerate(zip(strings, doc, strict=True)) for i in range(len(s) - 49) if first[s[i : i + 50]] < d}
    rows = suffix_dedup.merged_transforms([np.frombuffer(s, np.uint8) for s in strings], np.array(doc), 50)
    assert {(int(k), int(a) + i) for k, a, n in rows for i in range(n)} == want


def test_odd_rows(odd, empty):
    got = {}
    for r in suffix_dedup.digest(odd).collect():
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"]))
    assert got[3] == [(0, 0)] and got[4] == [(0, 0)] and got[6] == [(4, 0)]
    assert len(got[1]) == 2 and got[2][0][0] == got[2][0][1] > 0 and got[7][0][1] == 0
    assert suffix_dedup.digest(empty).count() == 0


def test_filtered_leaves_valid_text(spark, odd, empty):
    got = suffix_dedup.filtered(odd)
    assert got.columns == odd.columns and suffix_dedup.filtered(empty).count() == 0
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert 2 not in texts and texts[8].strip() == "end" and texts[3] is None and texts[4] == ""
    shared = "©" + "q" * 60  # its last byte pattern also ends another character
    df = spark.createDataFrame([(1, "ab" + "é"[0] + "©" + "q" * 60), (2, "xyé" + "q" * 60 + " rest")], "doc_id long, text string")
    cut = {r["doc_id"]: r["text"] for r in suffix_dedup.filtered(df).collect()}
    assert cut[2] in ("xyé rest", "xy rest") and shared in cut[1]


def test_rows_without_doc_id_neither_take_nor_lose(spark, prose):
    text = prose(40, 1)
    rows = [(None, text), (None, text + " more"), (7, text), (3, "x " + text), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], bytes(r["kept"]).decode()): r["n_removed"] for r in suffix_dedup.duplicate_bytes(df).collect()}
    assert [n for (d, _), n in got.items() if d is None] == [0, 0, 0] and got[None, text] == 0
    assert got[3, "x " + text] == 0 and got[7, ""] == len(text)
    assert suffix_dedup.filtered(df).where("doc_id is null").count() == 3


def test_lengths_beyond_a_byte(spark, prose):
    passage = prose(90, 5)
    texts = {1: passage + " one", 2: "two " + passage, 3: passage[:280], 4: passage[100:420] + prose(9, 6)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = suffix_dedup.duplicate_bytes(df, least=300).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got} == plain(texts, 300)


def test_segments_that_polynomials_take_for_equal(spark):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    check(spark, {1: "start " + word + " end", 2: "start " + word.translate(str.maketrans("ab", "ba")) + " end"})
