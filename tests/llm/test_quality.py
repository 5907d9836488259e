"""Quality classifier: held-out accuracy, shrinkage, odd rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from larkspur.llm import quality


@pytest.fixture(scope="module")
def corpus(spark, prose):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(600):
        good, toxic = rng.random() < 0.7, rng.random() < 0.1
        text = prose(60, i) if good else " ".join("!!! @@ ## BUY" for _ in range(20)) + prose(5, i).upper()
        docs.append((i, text + (" vileword nastyword" if toxic else ""), rng.choice(["en", "fr"]), f"s{rng.randrange(5) if good else rng.randrange(4, 7)}"))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").cache(), labels


def test_held_out_accuracy(spark, corpus):
    docs, labels = corpus
    known = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judged(docs, known).collect()}
    held = [x for x in labels if not x[0] % 3]
    right = [got[d]["kept"] == bool(q and not t) for d, q, t in held]
    assert sum(right) / len(right) > 0.95


def test_sparse_places_stay_near_what_is_above(spark):
    seen = spark.createDataFrame([("big", "a", 3.0)] * 400 + [("big", "b", -3.0)] * 200 + [("mid", "a", -3.0)] * 300 + [("tiny", "a", -3.0)], "host string, path string, quality double")
    lift = {(r["host"], r["path"]): r["quality_lift"] for r in quality.shrunk(seen, "quality").collect()}
    assert lift["big", "a"] > 0 > lift["mid", "a"] and lift["mid", "a"] < lift["tiny", "a"] < lift["big", "a"]


def test_strength_falls_with_spread(spark):
    def of(rates):
        df = spark.createDataFrame([(100.0 * p, 100) for p in rates], "s double, n long")
        return quality.strength(df, F.col("s") / F.col("n"), F.col("n"), F.lit(0.5))

    assert of([0.5, 0.5, 0.51]) > of([0.3, 0.5, 0.7]) > of([0.01, 0.99])


def test_odd_rows(spark, odd, empty, corpus):
    _, labels = corpus
    known = spark.createDataFrame([(1, 1, None, "x"), (4, 0, 0, "x"), (7, 1, 1, "x"), (None, 1, 0, "x"), (99, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    assert quality.judged(odd, known).count() == 13
    kept = quality.filtered(odd, known)
    assert kept.columns == odd.columns and kept.count() <= 13
    assert quality.filtered(empty, known).count() == 0
    none = quality.filtered(odd, known.limit(0))
    assert none.count() == 13


def test_rows_with_one_id_are_judged_by_their_own_text(spark, corpus):
    docs, labels = corpus
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    twice = docs.unionByName(docs.where("doc_id = 0").withColumn("text", F.lit("!!! @@ ## BUY " * 20)))
    assert quality.judged(twice, known).where("doc_id = 0").count() == 2


def test_long_texts_and_null_ones_are_in_the_fit(spark, prose):
    """Labelled texts of 70,000 bytes and more alone teach the classifier; a labelled null text is one without words."""
    rng = random.Random(4)
    docs = [(i, (prose(12_000, i) if i % 2 else prose(9000, i).upper() + " !!! BUY" * 900), "en", "s") for i in range(24)] + [(100 + i, None, "en", "s") for i in range(8)]
    labels = [(i, i % 2, 0) for i in range(24)] + [(100 + i, 0, 0) for i in range(8)]
    fresh = [(200, prose(12_000, 900), "en", "s"), (201, prose(9000, 901).upper() + " !!! BUY" * 900, "en", "s"), (202, None, "en", "s")]
    rng.shuffle(docs)
    got = quality.judged(spark.createDataFrame(docs + fresh, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {r["doc_id"]: r["kept"] for r in got.where("doc_id >= 200").collect()} == {200: True, 201: False, 202: False}


def plain_lifts(seen):
    """(host, path) -> lift by loops over (host, path, log odds)."""
    import math

    groups, hosts = {}, {}
    for host, path, x in seen:
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))
        n, s = groups.get((host, path), (0, 0.0))
        groups[host, path] = (n + 1, s + p)
    for (host, _), (n, s) in groups.items():
        a, b = hosts.get(host, (0, 0.0))
        hosts[host] = (a + n, b + s)
    total = sum(n for n, _ in hosts.values())
    rate = sum(s for _, s in hosts.values()) / total

    def strength(rows):
        spread = sum(n * (r - p) ** 2 for n, r, p in rows)
        noise, most = sum(p * (1 - p) for _, _, p in rows), sum(n * p * (1 - p) for n, _, p in rows)
        n = sum(n for n, *_ in rows)
        between = (spread - noise) / n
        return min(quality.MOST_STRENGTH, max(quality.LEAST_STRENGTH, most / n / between - 1 if between > 1e-9 else quality.MOST_STRENGTH))

    above = strength([(n, s / n, rate) for n, s in hosts.values()])
    rates = {h: (s + above * rate) / (n + above) for h, (n, s) in hosts.items()}
    below = strength([(n, s / n, rates[h]) for (h, _), (n, s) in groups.items()])
    odds = lambda p: math.log(p / (1 - p))
    return {k: odds(min(1 - 1e-6, max(1e-6, (s + below * rates[k[0]]) / (n + below)))) - odds(rate) for k, (n, s) in groups.items()}


def plain_fit(features, y):
    """Feature -> weight, and the intercept: features chosen by chi-square over a table of counts, weights by Newton steps in double precision."""
    import numpy as np

    n, n1 = len(y), sum(y)
    count, ones = {}, {}
    for f, label in zip(features, y, strict=True):
        for x in f.tolist():
            count[x] = count.get(x, 0) + 1
            ones[x] = ones.get(x, 0) + label
    score = {x: (ones[x] - c * n1 / n) ** 2 / max(c * n1 / n * (1 - n1 / n) * (1 - c / n), 1e-9) for x, c in count.items() if c >= 3}
    kept = sorted(x for x in sorted(score, key=lambda x: (-score[x], x))[: quality.KEPT] if score[x] > quality.LEAST_SCORE)
    x = np.array([[k in set(f.tolist()) for k in kept] + [True] for f in features], float)
    w, ridge = np.zeros(len(kept) + 1), np.append(np.full(len(kept), 0.3), 1e-6)
    w[-1] = np.log(n1 / (n - n1))
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + np.diag(ridge), x.T @ (p - np.array(y)) + ridge * w)
        w -= np.clip(step, -4, 4)
        if abs(step).max() < 1e-4:
            break
    return dict(zip(kept, w[:-1], strict=True)), w[-1]


def test_query_against_a_plain_version(spark, corpus):
    import math

    docs, labels = corpus
    known = {d: (q, t) for d, q, t in labels if d % 4}
    got = {r["doc_id"]: r for r in quality.judged(docs, spark.createDataFrame([(d, *x) for d, x in known.items()], "doc_id long, quality int, toxic int")).collect()}
    rows = {r["doc_id"]: (r["source"], r["lang"], quality.feature_ids(r["text"] or "")) for r in docs.collect()}
    want = {d: {} for d in rows}
    for i, kind in enumerate(("quality", "toxic")):
        weights, start = plain_fit([rows[d][2] for d in known], [known[d][i] for d in known])
        logs = {d: start + sum(weights.get(x, 0.0) for x in f.tolist()) for d, (_, _, f) in rows.items()}
        lifts = plain_lifts([(*rows[d][:2], x) for d, x in logs.items()])
        for d, x in logs.items():
            want[d][kind] = 1 / (1 + math.exp(-(max(-30.0, min(30.0, x)) + lifts[rows[d][:2]])))
    for d, w in want.items():
        assert abs(got[d]["quality"] - w["quality"]) < 0.02 and abs(got[d]["toxic"] - w["toxic"]) < 0.02, d
        if min(abs(w["quality"] - 0.5), abs(w["toxic"] - 0.5)) > 0.02:
            assert got[d]["kept"] == (w["quality"] >= 0.5 and w["toxic"] < 0.5)
