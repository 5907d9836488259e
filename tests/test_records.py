"""Quotes, records, screening gate."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from larkspur.operators import snapshots
from larkspur.plans import compliance, quotes, records


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_quote_identity(spark):
    wire = spark.createDataFrame([("1@A", "AB", None, "C12.5"), ("2", None, None, "1"), ("9", "X", None, "1"), ("3", "CD", "late", "1")], "conidEx string, `55` string, error string, `31` string")
    ids = spark.createDataFrame([("1", "AB"), ("2", "B"), ("3", "CD"), ("4", "D")], "conid string, ticker string")
    good, bad = quotes.identified(quotes.named_fields(wire), ids)
    assert rows(bad.select("conid", "reason")) == [("2", "missing identity"), ("3", "error"), ("9", "unmatched conid")]
    assert rows(quotes.without_data(ids, good).select("conid")) == [("2",), ("3",), ("4",)]
    with pytest.raises(ValueError, match="3 quotes rejected: unknown: unmatched conid, B: missing identity"):
        quotes.must_be_clean(bad)
    quotes.must_be_clean(bad.limit(0))
    out = quotes.equity_snapshot(good, F.lit(dt.datetime(2024, 1, 2, 3, 4, 5)), spark.createDataFrame([("1", 7.5)], "conid string, average_return double"))
    assert rows(out.select("Last", "Current Yield", "Timestamp")) == [(12.5, 7.5, "20240102030405")]


def test_bond_snapshots(spark):
    df = spark.createDataFrame([("5", "99.50"), ("4", "0"), ("x", "1")], "Coupon string, Last string")
    assert rows(quotes.bond_snapshot(df).select("Last", F.round("Current Yield", 6))) == [("1", None), ("99.50", 5.025126)]
    assert quotes.bond_snapshot(df, treasury=True).count() == 3


def test_merged_responses(spark):
    prepared = spark.createDataFrame([("F-1", "Prepared", None), ("F-2", "Skipped", "s"), ("F-3", "Prepared", None)], "form string, status string, message string")
    answers = spark.createDataFrame([(1, "f1", None, "ok"), (1, "f2", "Done", "x")], "n int, form string, status string, message string")
    assert rows(records.merged_responses(prepared, answers)) == [("F-1", "Submitted", "ok"), ("F-2", "Skipped", "s"), ("F-3", "Prepared", None)]
    assert rows(records.merged_responses(prepared, answers.limit(0)).select("form", "status")) == [("F-1", "Accepted"), ("F-2", "Skipped"), ("F-3", "Accepted")]


def test_request_faults(spark):
    schema = "account_id string, contact_id string, recipient_email string, recipient_source string, language string, missing_document_keys array<string>, content struct<missing_documents:array<string>,is_company_contact:boolean>"
    ok = ["a", "c", "m", "contact", "en", [" POI", "poi"], (["x"], None)]
    change = lambda **k: tuple(k.get(n, v) for n, v in zip(("a", "c", "m", "source", "language", "keys", "content"), ok, strict=True))
    data = [tuple(ok), change(m=" "), change(source="fax"), change(language="fr"), change(keys=[]), change(keys=["zzz"]), change(keys=["poi", "poe"]), change(content=([], None)), change(content=(["x"], True)), change(keys=["poe"])]
    got = records.request_faults(spark.createDataFrame(data, schema)).collect()
    assert got[0]["keys"] == ["poi"] and got[0]["fault"] is None
    words = ["Missing", "recipient_source", "language", "non-empty", "unsupported", "both", "content", "Company", "Natural"]
    assert all(w in r["fault"] for w, r in zip(words, got[1:], strict=True))


def test_screening_gate(spark):
    links = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a"), (None, "a"), ("3", None)], "contact_id string, account_id string")
    done = spark.createDataFrame([("2", "20240115080000"), ("1", "20240114080000"), ("1", "junk")], "contact_id string, created string")
    day, a = F.lit(dt.date(2024, 1, 15)), spark.range(3)
    assert rows(compliance.to_screen(links, done, day, [snapshots.compared(a, a), snapshots.compared(a, spark.range(2))])) == [("1",)]
    assert rows(compliance.to_screen(links, done, day, [snapshots.compared(a, a)])) == []
    assert rows(compliance.to_screen(links, done, day, [snapshots.compared(a, None)])) == [("1",)]


def test_backups_and_inputs(spark):
    noon = dt.datetime(2024, 1, 15, 12)
    files = spark.createDataFrame([("p1", "bonds_20240115.csv", "batch", noon), ("p2", "bondsy_1.csv", "batch", noon), ("p3", "old.csv", "B", noon), ("p4", "older.csv", "B", noon - dt.timedelta(days=1))], "path string, name string, folder string, modified timestamp")
    reports = spark.createDataFrame([("bonds", "B", "bonds 0115")], "prefix string, backup_folder string, backup_name string")
    assert rows(records.backup_moves(files, reports, F.lit(dt.date(2024, 1, 15)))) == [("p1", "B/bonds 0115", 1)]
    assert records.chosen_input(files, "old.csv", "bonds") == "p3" and records.chosen_input(files, "none", "bonds_") == "p1"
    with pytest.raises(ValueError, match="no file"):
        records.chosen_input(files, "x", "y")
    steps = spark.createDataFrame([("a", "success"), ("a", "skipped"), ("b", "failed"), ("b", "success"), ("c", "failed")], "pipeline string, status string")
    assert rows(records.status_report(steps)) == [("a", 1, 0, 1, "success"), ("b", 1, 1, 0, "partial"), ("c", 0, 1, 0, "failed")]


def test_cache_and_population(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, text string")
    cache = docs.where("id = 3").select(records.cache_key(F.col("text"), "s").alias("key"), F.lit("r").alias("result"))
    hits, todo = records.cached(docs, "text", "s", cache)
    assert rows(hits.select("id", "result")) == [(3, "r")] and todo.count() == 1
    assert records.cached(docs, "text", "other", cache)[1].count() == 2
    links = spark.createDataFrame([(1,), (1,), (2,), (3,)], "document_id int")
    done = spark.createDataFrame([(1, "failed"), (1, "completed"), (2, "failed")], "document_id int, status string")
    assert rows(records.population(links, done)) == [(4, 3, 2, 1, 2)]
