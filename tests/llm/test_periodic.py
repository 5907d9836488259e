"""Periodic runs: every run against a search of all periods, the query against a plain version."""

from __future__ import annotations

import random
import re
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import periodic


def all_runs(words):
    """Every run, by trying each period at each place."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(12, 2 * q):
                found.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def searched(words):
    value = np.unique(np.array(words), return_inverse=True)[1].astype(np.int64) if words else np.zeros(0, np.int64)
    return periodic.runs_of_texts(value, np.array([0, len(words)]))[0]


PART = st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 8))


@settings(max_examples=400, deadline=None)
@given(st.lists(PART, max_size=6))
def test_runs_against_all_periods(parts):
    words = [w for unit, n in parts for w in unit * n]
    assert searched(words) == all_runs(words)


@pytest.mark.parametrize("seed", range(12))
def test_long_texts_with_nested_and_touching_runs(seed):
    rng = random.Random(seed)
    words = []
    while len(words) < 1500:
        unit = [rng.randrange(rng.choice((2, 5, 60))) for _ in range(rng.choice((1, 2, 3, 7, 15, 31, 64, 100)))]
        if rng.random() < 0.3:
            unit = unit[: len(unit) // 2 + 1] * 2
        words += unit * rng.choice((1, 1, 2, 3, 5)) + unit[: rng.randrange(len(unit) + 1)]
    assert searched(words) == all_runs(words)


def test_one_word_many_times_is_quick_and_whole():
    assert searched([1] * 100_000) == [(0, 100_000, 1)]
    assert searched([1, 2, 3] * 30_000 + [4] + [1, 2, 3] * 30_000) == [(0, 90_000, 3), (90_001, 90_000, 3)]


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = all_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, sha256(listed.encode()).hexdigest(), sha256(kept.encode()).hexdigest())


def test_query_against_a_plain_version(spark, odd, prose):
    texts = [prose(30 + 11 * i, i) for i in range(60)] + ["la la la\tla " * 40, "a\nb c " * 9 + "a b", "x " * 12, "x " * 11, "Ünï cødé " * 7]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "t u " * 20), (3, "again " * 30), (3, "again " * 30)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    df = odd.unionByName(more, allowMissingColumns=True)
    got = sorted((tuple(r) for r in periodic.digest(df).collect()), key=repr)
    want = sorted((plain(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=repr)
    assert got == want and sum(r[1] > 0 for r in got) > 8
    runs = {(r["doc_id"], r["start"], r["length"], r["period"]) for r in periodic.runs(more).collect()}
    assert (62, 0, 12, 1) in runs and not any(r[0] == 63 for r in runs)
    assert {r["text"] for r in periodic.collapsed(more).collect() if r["doc_id"] == 61} == {"a b c"}


def test_empty_table(spark, empty):
    assert periodic.digest(empty).collect() == [] and periodic.runs(empty).collect() == []
