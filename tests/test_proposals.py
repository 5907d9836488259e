"""Many proposals in one job, against one at a time."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from larkspur.fixed_values import ARCHETYPES
from larkspur.plans import portfolio


def test_proposals_equal_single_ones(spark):
    rng = random.Random(1)
    rows = [(f"T{rng.randrange(30)}", f"S{i}", round(rng.uniform(0.5, 12), 2), rng.choice(("AA", "BBB+", "BB", "UST", "A", "B"))) for i in range(600)]
    candidates = portfolio.universe(spark.createDataFrame(rows, "Ticker string, Symbol string, `Current Yield` double, `S&P Equivalent` string")).where("bucket <> ''").cache()
    profiles = {1: (0.2, 0.2, 0.4, 0.2, 0.0), 2: (0.5, 0.5, 0.0, 0.0, 0.0), 3: (0.0, 0.05, 0.9, 0.05, 0.0), 4: (0.125, 0.375, 0.25, 0.25, 0.0)}
    weights = F.struct(*[F.col(b) for b in portfolio.WEIGHTED]).alias("weights")
    many = portfolio.proposals(candidates, spark.createDataFrame([(k, *map(float, w)) for k, w in profiles.items()], "k int, " + ", ".join(f"{b} double" for b in portfolio.WEIGHTED)).select("k", weights), "k")
    got = {k: {(r["bucket"], r["Symbol_x"]) for r in many.collect() if r["k"] == k} for k in profiles}
    for k, w in profiles.items():
        alone = portfolio.proposal(candidates, dict(zip(portfolio.WEIGHTED, w, strict=True))).where("round = 1").collect()
        assert got[k] == {(r["bucket"], r["Symbol_x"]) for r in alone} and got[k]


def test_plans_as_columns_equal_plain_ones(spark):
    rows = []
    for a in ARCHETYPES:
        w = dict(zip(portfolio.WEIGHTED, a[2:7], strict=True))
        default = portfolio.default_allocation(w) | portfolio.default_ratings(w)
        rows += [(a[1], tuple(default[k] for k in portfolio.PLAN)), (f" {a[1]} ", tuple(default[k] + (k == "bonds") for k in portfolio.PLAN))]
    rows += [("unknown", (10.0, 20.0, 40.0, 30.0, 50.0, 25.0, 25.0)), (None, (None, None, 0.0, 0.0, None, None, None))]
    df = spark.createDataFrame(rows, "archetype string, plan struct<" + ",".join(f"{k}:double" for k in portfolio.PLAN) + ">")
    for r in portfolio.plan_weights(df).collect():
        plan = r["plan"].asDict()
        want = portfolio.plan_distribution(plan, plan, r["archetype"])
        assert {b: round(x, 12) for b, x in r["weights"].asDict().items()} == {b: round(x, 12) for b, x in want.items()}, r


def test_a_glossary_skips_what_no_longer_fits(spark):
    from larkspur.fixed_values import GLOSSARY_CHARS, GLOSSARY_ENTRIES
    from larkspur.plans import documents

    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n))
    pairs = [(i, words(rng.choice((2, 7, 14))), words(rng.choice((2, 14)))) for i in range(160)]
    df = spark.createDataFrame(pairs, "document_id long, source string, translated string")
    entries = sorted(documents.glossary_entries(df).collect(), key=lambda r: (-r["total"], r["key"]))
    kept, used, skipped = [], 0, 0
    for r in entries:
        if used + len(r["entry"]) <= GLOSSARY_CHARS and len(kept) < GLOSSARY_ENTRIES:
            kept.append(r["entry"])
            used += len(r["entry"]) + 1
        else:
            skipped += len(kept) < GLOSSARY_ENTRIES
    got = documents.translation_memory(df).first()
    assert got["glossary"] == "\n".join(kept) and got["entries"] == len(kept) and skipped
    places = [next(i for i, r in enumerate(entries) if r["entry"] == k) for k in kept]
    assert places != list(range(len(kept)))  # something in between was skipped
