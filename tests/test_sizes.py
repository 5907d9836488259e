"""Operators at sizes and in forms that the registered queries do not reach."""

from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from larkspur.fixed_values import FORMULA_COLUMNS, GLOSSARY_CHARS, POSITION_COLUMNS
from larkspur.functions import text
from larkspur.operators import selection, snapshots
from larkspur.plans import documents, records, reports
from larkspur.streaming import ledgers


def test_more_than_ten_thousand_protected_values(spark):
    source = " ".join(f"w {i}" for i in range(10_001))
    rows = documents.protected(spark.createDataFrame([(1, source, "x")], "id int, text string, row string"))
    back = documents.restored(rows, "protected").first()
    assert len(back["values"]) == 10_001 and back["fault"] is None and back["restored"] == source and back["row"] == "x"
    lost = documents.restored(rows.withColumn("protected", F.replace("protected", F.lit("ZZX9100018XZZ"), F.lit(""))), "protected").first()
    assert lost["restored"] is None and lost["fault"].endswith("ZZX9100018XZZ")


def test_placeholders_given_twice_or_lost(spark):
    rows = spark.createDataFrame([(["1", "2"], "ZZX900018XZZ ZZX900028XZZ"), (["1", "2"], "ZZX900018XZZ ZZX900018XZZ"), ([], "plain")], "values array<string>, translated string")
    got = [(r["restored"], (r["fault"] or "")[-12:]) for r in documents.restored(rows).collect()]
    assert got == [("1 2", ""), (None, "ZZX900028XZZ"), ("plain", "")]


def test_a_glossary_goes_on_after_entries_that_do_not_fit(spark):
    """Against a loop over all entries in order: long ones fill the budget, a short one of low rank still fits."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    lines = [(alphabet[i // 26] + alphabet[i % 26] + "q" * 92, "Z" + alphabet[i // 26] + alphabet[i % 26] + "k" * 92) for i in range(45)] + [("hi", "yo")]
    pairs, counts = [], {}
    for i, (s, t) in enumerate(lines):
        counts[s] = 100 - i if i < 45 else 1
        pairs += [(i, s, t)] * counts[s]
    entries = [f"{s} = {t}" for s, t in sorted(lines, key=lambda x: (-counts[x[0]], x[0]))]
    kept, used = [], 0
    for e in entries:
        if used + len(e) <= GLOSSARY_CHARS and len(kept) < 100:
            kept.append(e)
            used += len(e) + 1
    got = documents.translation_memory(spark.createDataFrame(pairs, "document_id int, source string, translated string")).first()
    assert got["glossary"].split("\n") == kept and kept[-1] == "hi = yo" and got["entries"] == len(kept) < len(entries)


def test_packing_lines_is_linear(spark, one):
    def plain(source, most):
        chunks, held = [], None
        for line in source.split("\n"):
            if held is not None and len(held) + 1 + len(line) <= most:
                held += "\n" + line
            else:
                if held is not None:
                    chunks.append(held)
                held = line
        return [c.strip(" ") for c in [*chunks, held] if c.strip(" ")]

    for source in ("", "a", "\n\na\n", "ab\ncd\nef", "x" * 30 + "\nb\n\n" + "y" * 9, "a b\n c \n\n d"):
        assert one(text.packed_lines(F.lit(source), 8)) == plain(source, 8)
    long = "\n".join(f"line {i} of a long text" for i in range(60_000))
    begin = time.perf_counter()
    got = spark.createDataFrame([(long,)], "t string").select(text.packed_lines(F.col("t")).alias("c")).first()["c"]
    assert got == plain(long, 2200) and time.perf_counter() - begin < 60


def test_positions_template(spark):
    row = {c: None for c in POSITION_COLUMNS} | {"Conid": "7", "Quantity": "1.5"}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"`{c}` string" for c in POSITION_COLUMNS))
    got = reports.open_positions(df)
    assert got.columns == [*POSITION_COLUMNS, *FORMULA_COLUMNS] and len(got.columns) == 90
    values = list(got.first())
    assert values.count("") == 88 and values[POSITION_COLUMNS.index("Conid")] == "7"
    with pytest.raises(ValueError, match="Weight"):
        reports.open_positions(df.drop("Weight"))


def test_json_safe(spark):
    kind = "f double, t timestamp_ntz, d date, a array<double>, m map<int,double>, s struct<x:float,n:int>"
    df = spark.createDataFrame([(float("nan"), dt.datetime(2024, 1, 2, 3, 4, 5), dt.date(2024, 1, 2), [1.0, float("inf"), None], {1: float("nan"), 2: 3.0}, (float("nan"), 4)), (1.5, None, None, None, None, None)], kind)
    first, second = selection.json_safe(df).collect()
    assert tuple(first) == (None, "2024-01-02T03:04:05.000000", "2024-01-02", [1.0, None, None], {"1": None, "2": 3.0}, (None, 4))
    assert tuple(second) == (1.5, None, None, None, None, None)


def test_backup_and_samples(spark):
    files = spark.createDataFrame([("list_20240101_a",), ("list_20240101_b",), ("list_20240102",), ("other_20240101",)], "name string")
    day = lambda d: [tuple(r) for r in records.backup_of_day(files, "list_", F.lit(d).cast("date")).collect()]
    assert day("2024-01-01") == [("list_20240101_b", "2024-01-01")] and day("2024-01-05") == []
    new, old = spark.range(10).selectExpr("id", "'x' AS b"), spark.range(7, 20).selectExpr("id", "'x' AS b")
    got = snapshots.change_summary(new, old, 2).first()
    assert (got["added"], got["removed"]) == (7, 10) and got["added_samples"] == ['{"b":"x","id":0}', '{"b":"x","id":1}']
    same = snapshots.change_summary(new, new).first()
    assert tuple(same) == (0, 0, [], [])


def test_signatures_by_key(spark):
    rows = [("a", 1), ("a", 2), ("b", 2), ("b", 1), ("c", 1), ("c", 1)]
    got = {r["k"]: r["signature"] for r in snapshots.signature(spark.createDataFrame(rows, "k string, n int"), ("k",)).collect()}
    assert got["a"] == got["b"] != got["c"]


def test_sessions_of_a_stream(spark, tmp_path):
    events = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, m)) for m in (0, 5, 50)] + [(2, dt.datetime(2024, 1, 9))], "k int, ts timestamp")
    events.write.parquet(f"{tmp_path}/in")
    stream = ledgers.sessions(ledgers.stream(spark, f"{tmp_path}/in", events.schema), "ts", "k", "30 minutes")
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["n"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]
