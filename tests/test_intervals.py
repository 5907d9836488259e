"""Range and box joins against plain loops, without nested loops in the plan; exact quantiles and places without one task holding a group."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspur.operators import intervals, joins, profiles, ranks, selection


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def drawn(seed, n):
    rng = random.Random(seed)
    lows = [rng.choice((rng.uniform(-50, 50), rng.expovariate(0.01), float(rng.randrange(40)))) for _ in range(n)]
    return [(i, x, x + rng.choice((0.0, 0.5, 3.0, 40.0, 5000.0))) for i, x in enumerate(lows)]


@pytest.mark.parametrize("cuts", [3, 64, 1023])
def test_values_in_ranges(spark, cuts):
    spans = [*drawn(1, 300), (900, None, 5.0), (901, 10.0, 2.0), (902, 7.0, 10.0)]
    values = [(i, random.Random(i).choice((None, 10.0, float(i % 45), i / 7 - 30, i * 1.5))) for i in range(400)]
    df, held = spark.createDataFrame(values, "id long, v double"), spark.createDataFrame(spans, "r long, lo double, hi double")
    got = sorted(((r["id"], r["r"]) for r in intervals.within(df, F.col("v"), held, "lo", "hi", 10.0, cuts).collect()), key=repr)
    want = []
    for i, v in values:
        found = [r for r, lo, hi in spans if v is not None and lo is not None and lo <= hi and lo <= v and (v < hi or v == hi == 10.0)]
        want += [(i, r) for r in found] or [(i, None)]
    assert got == sorted(want, key=repr)


def test_a_hundred_thousand_ranges(spark):
    n = 100_000
    rng = np.random.default_rng(3)
    lows = np.sort(rng.uniform(0, 1e6, n))
    highs = lows + rng.choice((0.5, 20.0, 30.0), n)
    highs[::1000] = lows[::1000] + 50_000  # a hundred wide ones
    values = rng.uniform(0, 1e6, 2000)
    spans = spark.createDataFrame(pd.DataFrame({"r": np.arange(n), "lo": lows, "hi": highs}))
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    joined = joins.in_range(df, F.col("v"), spans, "lo", "hi")
    assert "NestedLoop" not in plan(joined) and "Cartesian" not in plan(joined)
    got = {r["v"]: r["n"] for r in joined.groupBy("v").agg(F.count("r").alias("n")).collect()}
    assert got == {v: int(((lows <= v) & (v < highs)).sum()) for v in values.tolist()}


@pytest.mark.parametrize("seed", [1, 2])
def test_points_in_boxes(spark, seed):
    rng = random.Random(seed)
    points = [(i, i % 3, rng.choice((rng.uniform(-20, 120), float(rng.randrange(9)))), rng.uniform(0, 80)) for i in range(300)] + [(900, 0, None, 1.0), (901, 1, 1e9, 5.0), (902, None, 1.0, 1.0)]
    boxes = [(i, i % 3, x := rng.choice((rng.uniform(-30, 110), 4.0)), y := rng.uniform(-5, 70), x + rng.choice((0.0, 1e-9, 2.5, 30.0, 1000.0)), y + rng.choice((0.0, 1.0, 16.0, 90.0))) for i in range(200)]
    boxes += [(901, 1, 1e9, 5.0, 1e9, 5.0), (902, 0, 5.0, 5.0, 1.0, 1.0), (903, 2, None, 0.0, 1.0, 1.0)]
    p = spark.createDataFrame(points, "p long, page long, x double, y double")
    b = spark.createDataFrame(boxes, "b long, page long, l double, t double, r double, m double")
    joined = intervals.inside(p, "x", "y", b, ("l", "t", "r", "m"), ["page"])
    assert "NestedLoop" not in plan(joined) and "Cartesian" not in plan(joined)
    want = sorted((i, k) for i, page, x, y in points for k, other, le, t, r, m in boxes if page is not None and page == other and x is not None and le is not None and le <= x <= r and t <= y <= m)
    assert sorted((r["p"], r["b"]) for r in joined.collect()) == want and (901, 901) in want


def groups(spark):
    rng = np.random.default_rng(5)
    parts = {
        "half": np.round(rng.lognormal(3, 2, 6000), 3), "even": np.arange(1500.0), "one": np.full(2500, 7.25), "two": np.array([1.0, 2.0]), "single": np.array([-3.5]),
        "far": np.concatenate([[-1e300, 1e300], rng.normal(0, 1e-3, 3000)]), "few": np.repeat([0.0, 5.0, 5.5], [1200, 1, 999]),
    }
    df = pd.concat([pd.DataFrame({"g": k, "v": v}) for k, v in parts.items()] + [pd.DataFrame({"g": ["none", "two"], "v": [None, None]})])
    return parts, spark.createDataFrame(df, "g string, v double").repartition(7)


@pytest.mark.parametrize("most", [50, 800])
def test_quantiles_of_huge_groups(spark, most):
    parts, df = groups(spark)
    fractions = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["g"]: r for r in ranks.quantiles(df.replace(float("nan"), None), ["g"], "v", fractions, sorted_values=most, bins=16).collect()}
    same = {r["g"]: r["q"] for r in df.replace(float("nan"), None).groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, fractions))).alias("q")).collect()}
    assert set(got) == {*parts, "none"} and got["none"]["q"] is None and got["none"]["n"] == 0
    for g, values in parts.items():
        assert got[g]["n"] == len(values) and got[g]["q"] == same[g]


def test_quantiles_without_keys_and_profiles(spark, monkeypatch):
    _, df = groups(spark)
    df = df.where("g in ('half', 'even', 'few')")
    want = profiles.profile(df, ["g"], "v").orderBy("g").collect(), profiles.profile(df, [], "v").collect()
    monkeypatch.setattr(ranks.quantiles, "__defaults__", (40, 32))
    assert (profiles.profile(df, ["g"], "v").orderBy("g").collect(), profiles.profile(df, [], "v").collect()) == want


def test_batches_over_ranges(spark):
    n = 1234
    df = spark.createDataFrame([(i * 7 % 5000, "x") for i in range(n)], "id long, _other string")
    got = selection.numbered_batches(df, 75, "id", rows_a_task=100)
    places = {k: p // 75 for p, k in enumerate(sorted(i * 7 % 5000 for i in range(n)))}
    assert {r["id"]: r["batch"] for r in got.collect()} == places
    sizes = sorted(r["count"] for r in got.groupBy("batch").count().collect())
    assert sizes == [n % 75] + [75] * (n // 75) and selection.numbered_batches(df.limit(0), 75, "id").count() == 0
    assert max(r["count"] for r in ranks.numbered(df, "id", "n", 100).groupBy(F.spark_partition_id()).count().collect()) <= n


def test_bucket_is_a_binary_search(spark):
    cuts = [0.5, 1.0, 2.0, 2.5, 9.0]
    values = [-1.0, 0.5, 0.75, 2.0, 2.4, 9.0, 99.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(intervals.bucket(F.col("v"), cuts)).collect()] == [0, 1, 1, 3, 3, 5, 5, None]
