"""Winnowing against a plain loop; guarantees; the query's edited texts."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from larkspur.llm import fingerprints


def plain(spark, text):
    """(hash, place) selected by a loop: the least of each window, the rightmost of equals."""
    raw = text.encode()
    if not raw:
        return []
    grams = [raw[i : i + fingerprints.GRAM] for i in range(max(1, len(raw) - fingerprints.GRAM + 1))]
    hashes = [r["h"] & 0x7FFFFFFF for r in spark.createDataFrame([(i, bytearray(g)) for i, g in enumerate(grams)], "i int, g binary").orderBy("i").select(F.xxhash64("g").alias("h")).collect()]
    chosen = []
    for a in range(max(1, len(hashes) - fingerprints.WINDOW + 1)):
        window = hashes[a : a + fingerprints.WINDOW]
        best = a + max(i for i, h in enumerate(window) if h == min(window))
        if not chosen or chosen[-1] != best:
            chosen.append(best)
    return [(hashes[i], i) for i in chosen]


def test_against_a_loop(spark, prose):
    texts = {1: prose(60, 1), 2: "aaaa" * 30, 3: "é" * 40, 4: "short", 5: "x" * 16, 6: "abcdefghij" * 9, 7: ""}
    got = {r["doc_id"]: [(p["hash"], p["place"]) for p in r["positions"]] for r in fingerprints.fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {d: plain(spark, t) for d, t in texts.items()}


def test_shared_passages_share_a_hash(spark, prose):
    rng = random.Random(2)
    passage = prose(12, 77)[: fingerprints.GRAM + fingerprints.WINDOW - 1]
    rows = [(i, prose(rng.randrange(40), i) + passage + prose(rng.randrange(40), 100 + i)) for i in range(20)]
    sets = [{p["hash"] for p in r["positions"]} for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert all(a & b for a in sets for b in sets)


def test_query(spark, prose, monkeypatch):
    monkeypatch.setattr(fingerprints, "DOCUMENTS_A_BIN", 7)
    rng = random.Random(3)
    texts = {d: rng.choice([prose(rng.randrange(1, 60), d), "", None, "same text here", "éàü" * 5]) for d in rng.sample(range(1000), 40)}
    got = {r["doc_id"]: r for r in fingerprints.digest(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect()}
    ids = sorted(texts, reverse=True)
    for i, d in enumerate(ids):
        own, after = texts[d] or "", texts[ids[(i + 1) % len(ids)]] or ""
        third = len(own) // 3
        edited = own[: len(own) - third] + after[:third]
        assert (got[d]["n_chars"], got[d]["edited_sha256"]) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert (got[d]["edited_fingerprint"] == got[d]["fingerprint"]) == (edited == own) or edited != own
        a, b = ({p[0] for p in plain(spark, t)} if len(own) < 90 else None for t in (own, edited))
        if a is not None:
            assert abs(got[d]["near_edited"] - (len(a & b) / len(a | b) if a | b else 1)) < 1e-9
        if len(own) < 90 and len(after) < 90:
            b = {p[0] for p in plain(spark, after)}
            assert abs(got[d]["near_next"] - (len(a & b) / len(a | b) if a | b else 1)) < 1e-9
    for d in [d for d in ids if len(texts[d] or "") > 120][:6]:
        i = ids.index(d)
        own, after = texts[d], texts[ids[(i + 1) % len(ids)]] or ""
        edited = own[: len(own) - len(own) // 3] + after[: len(own) // 3]
        assert got[d]["edited_fingerprint"] == " ".join(f"{h:X}.{p:X}" for h, p in plain(spark, edited))
        assert got[d]["fingerprint"] == " ".join(f"{h:X}.{p:X}" for h, p in plain(spark, own))
    same = {r["fingerprint"] for r in got.values() if texts[r["doc_id"]] == "same text here"}
    assert len(same) == 1


def test_odd_rows(odd, empty):
    got = {}
    for r in fingerprints.digest(odd).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == 13 and got[1][0]["fingerprint"] == got[2][0]["fingerprint"]
    assert got[3][0]["fingerprint"] == got[4][0]["fingerprint"] == "" and got[4][0]["n_chars"] == 0
    assert fingerprints.digest(empty).count() == 0


def test_one_document(spark):
    r = fingerprints.digest(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert (r["edited_sha256"], r["near_next"]) == (hashlib.sha256(b"abcdab").hexdigest(), 1.0)


def test_ids_far_apart_and_null_ones(spark, monkeypatch):
    """Bins follow the ids that there are: gaps leave none large; null ids are spread."""
    monkeypatch.setattr(fingerprints, "DOCUMENTS_A_BIN", 5)
    ids = [-(2**63), -(10**15), *range(40), 10**15, 2**63 - 1]
    rows = [(i, f"text number {i % 7} " * 3) for i in ids] + [(None, f"no id {k}") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.digest(docs.where("doc_id is not null")).collect()}
    texts, down = dict(rows), sorted(ids, reverse=True)
    for i, d in enumerate(down):
        own, after = texts[d], texts[down[(i + 1) % len(down)]]
        third = len(own) // 3
        assert got[d]["edited_sha256"] == hashlib.sha256((own[: len(own) - third] + after[:third]).encode()).hexdigest()
    assert fingerprints.digest(docs).count() == len(rows)
    bins = fingerprints.in_bins(docs, 9).groupBy("bin").count().collect()
    assert max(r["count"] for r in bins) <= 12 and sum(r["bin"] < 0 for r in bins) > 3
