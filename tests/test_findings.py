"""Faults that a reviewer found at larger sizes or in odd rows."""

from __future__ import annotations

import itertools
import random
import time

from pyspark.sql import functions as F

from larkspur.operators import intervals, joins, profiles, ranks
from larkspur.plans import catalogue, catalogue_frames, compliance, documents, portfolio, records  # noqa: F401 (the second registers queries in the first)
from larkspur.sources import parsers


def test_a_name_that_many_contacts_and_accounts_share(spark):
    """20,000 contacts and accounts of one name: 400 million pairs, of which one an each contact counts."""
    n = 20_000
    contacts = spark.range(n).select("id", F.lit(None).cast("string").alias("email"), F.lit("Ann").alias("name"))
    stamp = F.lpad((F.col("id") % 7).cast("string"), 2, "0")
    accounts = spark.range(n).select("id", F.lit("").alias("email"), F.array(F.lit("ann"), F.lit("ANN")).alias("names"), stamp.alias("updated"), F.lit(None).cast("string").alias("created"))
    begin = time.perf_counter()
    got = records.account_by_contact(contacts, accounts).groupBy("account_id").count().collect()
    assert [tuple(r) for r in got] == [(6, n)] and time.perf_counter() - begin < 60


def test_the_newer_of_mail_and_name_and_ties(spark):
    contacts = spark.createDataFrame([(1, "A@x", "Ann"), (2, None, "Bo"), (3, "c@x", ""), (4, None, None)], "id int, email string, name string")
    accounts = spark.createDataFrame([(9, "a@x", ["zoe"], "02", None), (8, "", ["ann"], "01", None), (7, "c@x", ["bo"], None, "05"), (6, "c@x", ["bo"], "05", "09")], "id int, email string, names array<string>, updated string, created string")
    assert sorted(tuple(r) for r in records.account_by_contact(contacts, accounts).collect()) == [(1, 9), (2, 6), (3, 6)]


def test_a_landed_report_of_several_files_is_read_whole(spark, tmp_path):
    part = spark.range(400).select(F.col("id").alias("p_partkey"), F.lit("n").alias("p_name"), (F.col("id") % 50).cast("int").alias("p_size"))
    part.repartition(4).write.parquet(f"{tmp_path}/part.parquet")
    got = catalogue.QUERIES["piped_reports"](spark, str(tmp_path)).groupBy("report").count().collect()
    assert {r["report"]: r["count"] for r in got} == {"raw": 400, "large": 192}


def test_quantiles_between_equal_values_are_these_values(spark):
    """No rounding may move a bound off the value that both neighbours have."""
    value = 900.07
    df = spark.range(300).select(F.lit("g").alias("g"), F.when(F.col("id") < 10, F.col("id").cast("double")).otherwise(F.lit(value)).alias("v"))
    fractions = [0.37, 0.61, 0.9, 0.93, 0.95]
    for most in (40, 10_000):
        assert ranks.quantiles(df, ["g"], "v", fractions, sorted_values=most, bins=16).first()["q"] == [value] * len(fractions)


def test_the_order_of_regions_does_not_show(spark):
    """Confidences whose sums differ in the last bit by their order: the mean and the score are the same, also at a half of the last place shown."""
    spelled = "x" * 9
    parts = [(spelled, 0.3), (spelled, 0.1), (spelled, 0.2), ("xy", 0.7), ("xy", 0.60001)]
    seen = set()
    for order in itertools.permutations(parts):
        seen.add(tuple(order))
    pages = [(i, 1, "some words", list(p), 0.9, []) for i, p in enumerate(sorted(seen))]
    df = spark.createDataFrame(pages, "document_id int, page_number int, text string, regions array<struct<text:string,confidence:double>>, image_quality double, defects array<struct<type:string,confidence:double>>")
    assert len(documents.document_quality(df).select("confidence", "quality.score").distinct().collect()) == 1


def test_names_of_a_contact_are_folded_once_and_plain_ones_not_at_all(spark):
    """Folding is the dear part: a contact's own names do not wait for each person, and ASCII skips the tables."""
    people = F.array(F.struct(F.lit("Ann").alias("firstName"), F.lit("B").alias("middleName"), F.lit("Cole").alias("lastName"), F.lit("a@x").alias("email")))
    df = spark.range(1).select(compliance.matched_person(people, F.lit("ann"), F.lit(None).cast("string"), F.lit("cole"), F.lit("")).alias("m"))
    assert df.first()["m"]["lastName"] == "Cole"
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("translate(") == 8  # two for each name: the contact's two, the person's two


def test_a_screen_sends_groups_to_the_tasks_not_rows(spark, tmp_path):
    spark.range(2000).select(F.concat(F.lit("g"), F.col("id") % 3).alias("g"), (F.col("id") % 97).cast("double").alias("v")).write.parquet(f"{tmp_path}/rows")
    got = profiles.screened(spark.read.parquet(f"{tmp_path}/rows"), ["g"], "v")
    assert 0 < got.count() < 2000
    assert "BuildLeft" not in got._jdf.queryExecution().executedPlan().toString()


def test_points_are_not_sent_once_for_each_size_of_box(spark):
    """F8: seven sizes of boxes, near one another: a point looks up fewer cells than sizes, and finds the same boxes."""
    rng = random.Random(8)
    points = [(i, rng.uniform(0, 300), rng.uniform(0, 300)) for i in range(2000)]
    boxes = [(i, x := rng.uniform(-20, 290), y := rng.uniform(-20, 290), x + rng.choice((3, 6, 12, 24, 48, 96, 900)), y + rng.choice((2.0, 5.0, 11.0))) for i in range(300)]
    p, b = spark.createDataFrame(points, "p long, x double, y double"), spark.createDataFrame(boxes, "b long, l double, t double, r double, m double")
    met = intervals.inside(p.withColumn("page", F.lit(1)), "x", "y", b.withColumn("page", F.lit(1)), ("l", "t", "r", "m"), ["page"])
    assert sorted((r["p"], r["b"]) for r in met.collect()) == sorted((i, k) for i, x, y in points for k, le, t, r, m in boxes if le <= x <= r and t <= y <= m)
    sizes = [(n, 100, 100 * 0.75 * 2.0**n, 600.0, 600 * 0.75 * 2.0**n) for n in (2, 3, 4, 5, 6, 7, 10)]
    chosen = intervals.levels_in_use(sizes, 10_000)
    assert set(chosen) == {n for n, *_ in sizes} and len(set(chosen.values())) <= 3
    assert all(-intervals.FINER <= at - n <= intervals.COARSER for n, at in chosen.items())


def test_ranges_and_values_that_lie_between_two_cuts(spark):
    """240,000 values and as many ranges beside them in one cell, of which few meet: 58 billion pairs before, a few now."""
    n = 240_000
    values = spark.range(n).select("id", F.when(F.col("id") % 1000 == 0, F.lit(-0.0)).otherwise((F.col("id") % 2 + F.col("id") / (2 * n))).alias("v"))
    ranges = spark.range(n).select(F.col("id").alias("r"), (0.501 + F.col("id") / 1e9).alias("lo"), (0.9 + F.col("id") / 1e9).alias("hi")).unionByName(spark.createDataFrame([(-1, 0.0, 1e-9), (-2, -1.0, 9.0)], "r long, lo double, hi double"))
    begin = time.perf_counter()
    got = {r["r"]: r["n"] for r in intervals.within(values, F.col("v"), ranges, "lo", "hi", cuts=1).groupBy("r").count().withColumnRenamed("count", "n").collect()}
    assert got == {-1: 240, -2: n} and time.perf_counter() - begin < 60


def test_quantiles_of_many_rows_with_few_values_take_few_jobs(spark):
    """F12, F16: groups of 30,000 rows and 50 values: counted, not refined round by round."""
    rows = spark.range(60_000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7 % 50 / 4).alias("v")).unionByName(spark.createDataFrame([(0, None), (2, None)], "g long, v double"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("few values", "")
    found = ranks.quantiles(rows, ["g"], "v", [0.1, 0.5, 0.9])
    jobs = len(tracker.getJobIdsForGroup("few values"))
    spark.sparkContext.setJobGroup("", "")
    got = {r["g"]: (r["n"], r["q"]) for r in found.collect()}
    want = {r["g"]: (r["n"], r["q"]) for r in rows.groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, (0.1, 0.5, 0.9)))).alias("q")).collect()}
    assert got == want and want[2] == (0, None) and jobs <= 4


def test_buckets_are_filled_once_for_all_profiles_that_ask_for_the_same(spark):
    """20,000 customers with two sets of weights."""
    candidates = spark.range(600).select(F.concat(F.lit("T"), "id").alias("Ticker"), F.concat(F.lit("S"), "id").alias("Symbol"), (F.col("id") % 40 / 4 + 2).alias("Current Yield"), F.element_at(F.array(*map(F.lit, ("AA", "BBB", "BB", "UST"))), (F.col("id") % 4 + 1).cast("int")).alias("S&P Equivalent"))
    share = F.when(F.col("id") % 2 == 0, F.lit(0.5)).otherwise(F.lit(0.25))
    weights = F.struct(share.alias("treasuries"), (1 - share).alias("bonds_aaa_a"), *[F.lit(0.0).alias(b) for b in ("bonds_bbb", "bonds_bb", "etfs")])
    begin = time.perf_counter()
    got = portfolio.proposals(portfolio.universe(candidates), spark.range(20_000).select("id", weights.alias("weights")), "id")
    sizes = {(r["odd"], r["bucket"]): r["n"] for r in got.groupBy((F.col("id") % 2).alias("odd"), "bucket").agg(F.count("*").alias("n")).collect()}
    assert sizes == {(0, "treasuries"): 100_000, (0, "bonds_aaa_a"): 100_000, (1, "treasuries"): 50_000, (1, "bonds_aaa_a"): 150_000} and time.perf_counter() - begin < 60
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan  # what follows the filling reads it


def test_parts_go_to_more_tasks_in_a_larger_table(spark, monkeypatch):
    """the number of tasks that sort lines follows from the lines, not from a setting; accounts go on over splits."""
    monkeypatch.setattr(joins, "ROWS_A_TASK", 100)
    lines = spark.range(4000).select(F.lit("f").alias("file"), F.floor(F.col("id") / 50).alias("part"), F.col("id").alias("line"), F.when(F.col("id") % 180 == 0, F.concat(F.lit("Account Information,Data,Account,A"), "id", F.lit(" x"))).when(F.col("id") % 3 == 1, F.lit("Other,Data,x,y")).otherwise(F.concat(F.lit('Change in NAV,Data,n,"1,'), F.lpad((F.col("id") % 900 + 100).cast("string"), 3, "0"), F.lit('"'))).alias("value"))
    rows = parsers.statement_rows(lines, None, F.lit("2024-01-31").cast("date"))
    got = sorted((r["Account"], r["Amount"]) for r in rows.collect())
    assert got == sorted((f"A{i - i % 180}", 1000.0 + i % 900 + 100) for i in range(4000) if i % 180 and i % 3 != 1)
    assert ", 40), REPARTITION_BY_NUM" in rows._jdf.queryExecution().executedPlan().toString()
