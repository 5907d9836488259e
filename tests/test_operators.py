"""Operators, sources, plans and streams on small tables."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import joins, profiles, selection, snapshots
from larkspur.plans import compliance, documents, pipeline, portfolio, reports
from larkspur.sources import parsers
from larkspur.sources import reports as files
from larkspur.streaming import ledgers


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- selection ---


def test_where_equal(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "n int, s string")
    assert rows(selection.where_equal(df, {"s": None})) == [(2, None)]
    assert rows(selection.where_equal(df, {"n": [1, 3], "zz": 1}, ignore_unknown=True)) == [(1, "a"), (3, "b")]
    with pytest.raises(ValueError, match="zz"):
        selection.where_equal(df, {"zz": 1})
    with pytest.raises(ValueError, match="lists"):
        selection.where_equal(df, {"n": [1]}, allow_lists=False)
    with pytest.raises(ValueError, match="no column"):
        selection.without_columns(df, ["n", "s"])
    with pytest.raises(ValueError, match="filter"):
        selection.guarded(df, {}, "s")


def test_batches_hold_all_rows(spark):
    df = spark.range(1000)
    got = selection.numbered_batches(df, 75, "id").groupBy("batch").count().collect()
    assert sum(r["count"] for r in got) == 1000 and max(r["count"] for r in got) <= 75


def test_validation_split(spark):
    good, bad = selection.split_valid(spark.range(10), [(F.col("id") < 2, "low"), (F.col("id") < 4, "lowish")])
    assert good.count() == 6 and rows(bad.groupBy("reason").count()) == [("low", 2), ("lowish", 2)]


# --- joins ---


def test_as_of_and_returns(spark):
    bars = spark.createDataFrame([("x", dt.date(2018 + i, 6, 1), 100.0 * 1.1**i) for i in range(6)] + [("y", dt.date(2020, 1, 1), 5.0)], "conid string, day date, close double")
    bars = bars.select("conid", F.col("day").cast("timestamp").alias("ts"), "close", F.lit(0).alias("n"))
    assert rows(reports.average_annual_return(bars)) == [("x", 10.0)]


def test_average_return_skips_bad_bars_and_keeps_the_last(spark):
    data = [("x", dt.datetime(2018 + i, 6, 1), 100.0, 0) for i in range(6)] + [("x", dt.datetime(2023, 6, 1), 150.0, 1), ("x", dt.datetime(2022, 9, 1), 0.0, 0), ("x", dt.datetime(2022, 9, 2), None, 0)]
    bars = spark.createDataFrame(data, "conid string, ts timestamp, close double, n int")
    assert rows(reports.average_annual_return(bars)) == [("x", 10.0)]


def test_archetype_ranges(spark):
    scores = spark.createDataFrame([("0.9",), ("2.999",), ("10",), ("10.1",), ("x",), (None,), ("0",)], "s string")
    got = {r["s"]: r["archetype"] for r in portfolio.with_archetype(scores, F.col("s")).collect()}
    assert got == {"0.9": "Conservative B", "2.999": "Aggressive B", "10": "Aggressive C", "10.1": None, "x": None, None: None, "0": "Conservative A"}


def test_right_join_keeps_quotes_and_fans_out(spark):
    lots = spark.createDataFrame([(7, "BOND", "LOT", 1.0), (7, "BOND", "LOT", 2.0), (8, "BOND", "SUMMARY", 3.0)], "Conid long, AssetClass string, LevelOfDetail string, Symbol double")
    quotes = spark.createDataFrame([("IBCID7",), (" IBCID8",), ("odd",)], "Symbol string")
    got = reports.positions_with_quotes(lots, quotes)
    assert rows(got.select("Symbol_y", "Symbol_x")) == [(" IBCID8", None), ("IBCID7", 1.0), ("IBCID7", 2.0), ("odd", None)]


def test_name_hits_once_per_entry(spark):
    people = spark.createDataFrame([(1, "José"), (2, "none"), (3, "")], "id int, name string")
    listed = spark.createDataFrame([("e1", ["jose", "jose"]), ("e2", ["jose", ""])], "e string, k array<string>")
    from larkspur.functions.text import normalized_name

    assert rows(joins.name_hits(people, "id", [normalized_name(F.col("name"))], listed, "e", F.col("k"), "l")) == [(1, "l", ["e1", "e2"])]


def test_first_match_prefers_feed_then_column(spark):
    wanted = spark.createDataFrame([("aa",), ("bb",), ("zz",)], "symbol string")
    first = spark.createDataFrame([(1, "AA ", "x"), (2, "q", "bb")], "n int, Symbol string, Ticker string")
    second = spark.createDataFrame([(3, "aa", "bb")], "n int, Symbol string, Ticker string")
    got = {r["symbol"]: (r["feed"], r["match"]) for r in joins.first_match(wanted, "symbol", [(first, ["Symbol", "Ticker"]), (second, ["Symbol"])], "n").collect()}
    assert got["aa"][0] == 0 and '"n":1' in got["aa"][1] and got["bb"][0] == 0 and got["zz"] == (None, None)


def test_upsert_update_delete(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert rows(joins.upserted(base, spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), "id")) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(joins.updated(base, F.col("id") > 1, {"v": F.lit("z")})) == [(1, "a"), (2, "z")]
    assert rows(joins.first_deleted(base, F.col("id") > 0, "id")) == [(2, "b")]
    assert rows(joins.first_deleted(base, F.col("id") > 9, "id")) == [(1, "a"), (2, "b")]


# --- snapshots and profiles ---


def test_signature_is_order_free_and_counts_rows(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "n int, s string")
    b = a.orderBy(F.desc("n"))
    sign = lambda d: snapshots.signature(d).first()["signature"]
    assert sign(a) == sign(b) != sign(a.distinct())
    assert rows(snapshots.compared(a, a)) == [(True, True, True, 0, 0)]
    assert rows(snapshots.compared(a, a.distinct())) == [(True, True, False, 0, 0)]
    assert rows(snapshots.compared(a, None)) == [(True, False, None, None, None)]


def test_anti_and_semi_make_the_whole(spark):
    a, b = spark.range(100), spark.range(50, 150, 3)
    assert a.join(b, "id", "left_anti").count() + a.join(b, "id", "left_semi").count() == 100


def test_screen_falls_back_to_all(spark):
    few = spark.createDataFrame([("a", 1.0), ("a", 100.0), ("b", 5.0), ("b", 5.1), ("b", 5.2), ("b", 5.1), ("b", 90.0), ("b", 5.0)], "k string, v double")
    got = profiles.screened(few, ["k"], "v")
    assert got.where("k = 'a'").count() == 2 and got.where("k = 'b'").agg(F.max("v")).first()[0] < 90


def test_distribution_sums_to_one(spark):
    got = profiles.distribution(spark.createDataFrame([("a", 3.0), ("b", 1.0), ("a", 1.0)], "k string, w double"), "k", F.col("w"))
    assert rows(got) == [("a", 0.8), ("b", 0.2)]


# --- portfolio ---


def plain_proposal(cands, weights):
    """The same by loops: (bucket, ticker, symbol, round)."""
    import numpy as np

    def clean(c):
        return [x for x in c if x[0].strip() and 0 < x[2] <= 25]

    def prof(v):
        m = np.median(v)
        d = max(np.median(np.abs(v - m)), 0.35)
        lo, up = max(0, m - 2.5 * d), min(np.quantile(v, 0.9), m + 2.5 * d)
        return lo, up, min(np.quantile(v, 0.75), m + 1.25 * d), max(up - lo, 1)

    wanted, used, out, profs = portfolio.needs(weights), set(), [], {}
    for b in portfolio.BUCKETS:
        c = clean([x for x in cands if x[3] == b])
        if not c:
            continue
        lo, up, *_ = prof(np.array([x[2] for x in c]))
        s = [x for x in c if lo <= x[2] <= up]
        s = s if len(s) >= max(3, min(5, len(c))) else c
        profs[b] = prof(np.array([x[2] for x in s]))
        key = lambda x, p=profs[b]: (-max(0, 1 - abs(x[2] - p[2]) / p[3]), abs(x[2] - p[2]), -x[2], x[0], x[1])
        seen = set()
        best = [x for x in sorted(s, key=key) if not (x[0] in seen or seen.add(x[0]))]
        got = [x for x in best if x[0] not in used][: wanted[b]]
        out += [(b, x[0], x[1], 1) for x in got]
        used |= {x[0] for x in got}
    short = {b: wanted[b] - sum(o[0] == b for o in out) for b in portfolio.BUCKETS}
    rest = [(x[0], x[1], x[2], x[3] or "bonds_bb") for x in clean(cands) if x[0] not in used]
    score = lambda x: max(0, 1 - abs(x[2] - profs[x[3]][2]) / profs[x[3]][3]) if x[3] in profs else 1.0
    seen = set()
    for x in sorted(rest, key=lambda x: (-score(x), -x[2], x[0], x[1])):
        if x[0] not in seen:
            seen.add(x[0])
            if short[x[3]] > 0:
                out.append((x[3], x[0], x[1], 2))
                short[x[3]] -= 1
    return sorted(out)


def test_proposal_matches_a_plain_loop(spark):
    rng = random.Random(5)
    names = {"AA": "bonds_aaa_a", "BBB-": "bonds_bbb", "BB": "bonds_bb", "UST": "treasuries", "CCC": ""}
    data = [(f"T{rng.randrange(25)}", f"S{i}", rng.choice([0.0, 30.0, *[rng.uniform(1, 9) for _ in range(8)]]), rng.choice(list(names))) for i in range(90)]
    raw = spark.createDataFrame([(t, s, y, e) for t, s, y, e in data], "`Ticker` string, `Symbol` string, `Current Yield` double, `S&P Equivalent` string")
    cands = [(r["Ticker"], r["Symbol_x"], r["Current Yield_x"], r["bucket"]) for r in portfolio.universe(raw).collect()]
    assert {c[1]: c[3] for c in cands} == {s: names[e] for _, s, _, e in data}
    weights = {"treasuries": 0.25, "bonds_aaa_a": 0.25, "bonds_bbb": 0.25, "bonds_bb": 0.25}
    got = portfolio.proposal(portfolio.universe(raw), weights)
    assert sorted((r["bucket"], r["Ticker"], r["Symbol_x"], r["round"]) for r in got.collect()) == plain_proposal(cands, weights)
    assert sum(portfolio.needs(weights).values()) == 20
    assert abs(sum(r["weight"] for r in portfolio.summary(got, weights).collect()) - 1) < 1e-9


def test_plan_distributions():
    assert portfolio.plan_distribution({"treasuries": 50, "bonds": 50}, {"aaa": 30, "bbb": 50, "bb": 20}) == pytest.approx({"treasuries": 0.5, "bonds_aaa_a": 0.15, "bonds_bbb": 0.25, "bonds_bb": 0.10, "etfs": 0})
    got = portfolio.plan_distribution({"treasuries": 50, "bonds": 50}, {"aaa": 30, "bbb": 70, "bb": 0}, "Conservative A")
    assert got == {"treasuries": 0.5, "bonds_aaa_a": 0.15, "bonds_bbb": 0.35, "bonds_bb": 0.0, "etfs": 0.0}


# --- compliance ---


def test_screenings(spark):
    application = '{"customer":{"type":"INDIVIDUAL","accountHolder":{"accountHolderDetails":[{"name":{"first":"A"},"residence":{"country":"USA"}}]}},"accounts":[{"margin":null,"tradingPermissions":[{"product":"STK","country":"USA"}]}]}'
    pep = application.replace('"name":{"first":"A"}', '"isPEP":true')
    contacts = spark.createDataFrame([("1", "Jane Doe"), ("2", "José Pérez"), ("3", "Lone"), ("4", "Pep")], "id string, name string")
    links = spark.createDataFrame([("1", "a", "2024", None), ("1", "b", "2023", None), ("2", "a", None, "2020"), ("4", "c", None, None)], "contact_id string, account_id string, updated string, created string")
    accounts = spark.createDataFrame([("a", "9", application), ("b", None, "{}"), ("c", "9", pep)], "id string, advisor_code string, application_json string")
    ofac = spark.createDataFrame([("77", " JANE DOE")], "entity_number string, name string")
    uk = spark.createDataFrame([("U1", "PEREZ", None, None, None, None, "Jose Perez")], "`Unique ID` string, `Name 1` string, `Name 2` string, `Name 3` string, `Name 4` string, `Name 5` string, `Name 6` string")
    un = spark.createDataFrame([("N1", "Other", "x|JANE  DOE")], "id string, name string, aliases string")
    got = {r["contact_id"]: r for r in compliance.screenings(contacts, links, accounts, ofac, uk, un).collect()}
    assert (got["1"]["ofac"], got["1"]["un"], got["1"]["risk_score"]) == (["77"], ["N1"], 9.0)
    assert got["2"]["uk"] == ["U1"] and got["2"]["risk_score"] == 9.0
    assert got["3"]["error"] == "linked account not found" and got["3"]["risk_score"] is None
    assert got["4"]["risk_score"] == pytest.approx(9 * 0.3 + 1 * 0.25 + 1 * 0.15 + 5 * 0.15 + 3 * 0.15)
    plain = {r["contact_id"]: r for r in compliance.screenings(contacts.where("id = '2'"), links, accounts, ofac, uk.limit(0), un).collect()}
    assert plain["2"]["risk_score"] == pytest.approx(1.90)
    done = spark.createDataFrame([("1",)], "contact_id string")
    assert compliance.screenings(contacts, links, accounts, ofac, uk, un, done).count() == 3


# --- reports ---


def test_ticket(spark):
    trades = spark.createDataFrame([("t", 1, -10.0, "1.5", -900.0, "90", "GM 5% Oct01'28", "NYSE"), ("t", 2, -10.0, "2.5", -910.0, "91", "GM 5% Oct01'28", "IBKR"), ("u", 1, 1.0, "0", 1.0, "1", "a", "X")], "k string, n int, Quantity double, AccruedInterest string, NetCash double, Price string, Description string, Exchange string")
    got = {r["k"]: r for r in reports.trade_ticket(trades, ["k"], [F.col("n")]).collect()}
    t = got["t"]
    assert (t["Quantity"], t["AccruedInterest"], t["Price"], t["TotalAmount"], t["Accrued (Days)"], t["type"], t["Exchange"], t["fault"]) == (20.0, 4.0, 90.5, 1814.0, 1440.0, "consolidated", "", None)
    assert got["u"]["type"] == "single" and got["u"]["fault"] == "no accrued interest"
    message = reports.trade_ticket(trades, ["k"], [F.col("n")]).where("k = 't'")
    assert "Maturity: 2028-10-01\nBuy/Sell: \n" in message.select(reports.ticket_message(message)).first()[0]


# --- sources ---


def test_control_records(spark, tmp_path):
    (tmp_path / "r.csv").write_text('BOF,1\nBOA,2\n"A","B, C",D\n1,"x ""y""",3\nA,"B, C",D\n2,,4\nEOA\nEOF,9\n')
    got = parsers.columns_of(parsers.control_record_report(parsers.numbered_lines(spark, str(tmp_path))), ["A", "B, C", "D", "E"])
    assert rows(got) == [("1", 'x "y"', "3", None), ("2", "", "4", None)]


def test_statements(spark, tmp_path):
    (tmp_path / "s.csv").write_text('﻿Account Information,Data,Account,U1 (x)\nChange in NAV,Data,Start,"1,234.50"\nChange in NAV,Data,Blank,\nAccount Information,Data,Account,U2\nChange in NAV,Data,Other,7\n')
    lines = parsers.numbered_lines(spark, str(tmp_path))
    day = F.lit(dt.date(2024, 1, 31))
    assert rows(parsers.statement_rows(lines, "U1", day)) == [(dt.date(2024, 1, 31), "Start", 1234.5, "U1")]
    (tmp_path / "s.csv").write_text("Account Information,Data,Account,U1\nChange in NAV,Data,Bad,abc\n")
    with pytest.raises(Exception, match="no amount"):
        parsers.statement_rows(parsers.numbered_lines(spark, str(tmp_path)), "U1", day).collect()


def test_statement_files(spark):
    found = parsers.statement_files(spark.createDataFrame([("p1", "U1_202401.csv"), ("p2", "U1_202401.CSV"), ("p3", "x.csv")], "path string, name string"))
    assert found.count() == 2
    assert rows(parsers.statement_faults(found, spark.createDataFrame([("U1",), ("U2",)], "account string"))) == [("U1", "several statements of 2024-01"), ("U2", "no statement")]


def test_sanctions_lists(spark, tmp_path):
    cells = lambda *a: (*a, *[None] * (12 - len(a)))
    part = spark.createDataFrame([cells("1", "DOE, JANE", "individual"), cells("2", "ACME, INC", "entity"), cells("3", "NOCOMMA", "Individual")], ", ".join(f"c{i} string" for i in range(12)))
    assert [r["name"] for r in parsers.ofac_entries([part]).orderBy("entity_number").collect()] == [" JANE DOE", "ACME, INC", "NOCOMMA"]
    (tmp_path / "uk.csv").write_text('note\nLast Updated,Unique ID,Name 1\n2024,U1,"A, B"\n')
    assert [r["row"]["Name 1"] for r in parsers.uk_entries(parsers.numbered_lines(spark, str(tmp_path))).collect()] == ["A, B"]
    (tmp_path / "un.xml").write_text("<L><INDIVIDUALS><INDIVIDUAL><DATAID>1</DATAID><FIRST_NAME>Al</FIRST_NAME><SECOND_NAME></SECOND_NAME><THIRD_NAME>Bo</THIRD_NAME><INDIVIDUAL_ALIAS><ALIAS_NAME>Zed</ALIAS_NAME></INDIVIDUAL_ALIAS><INDIVIDUAL_ALIAS><ALIAS_NAME></ALIAS_NAME></INDIVIDUAL_ALIAS></INDIVIDUAL></INDIVIDUALS><ENTITIES><ENTITY><DATAID>2</DATAID><FIRST_NAME>Co</FIRST_NAME></ENTITY></ENTITIES></L>")
    assert rows(parsers.un_entries(spark, str(tmp_path / "un.xml"))) == [("entity", "2", "Co", "", "UN"), ("individual", "1", "Al Bo", "Zed", "UN")]


def test_ids_and_sheets(spark):
    tickers = spark.createDataFrame([(1, "AB"), (2, "CD"), (3, "EF")], "n int, ticker string")
    found = spark.createDataFrame([("AB", "ABX", "1", 0, ["STK"]), ("AB", "ab", "2", 1, ["STK"]), ("CD", "CD", "3", 0, ["OPT"]), ("EF", "EF", "2", 0, ["STK"])], "ticker string, symbol string, conid string, place int, sections array<string>")
    assert rows(parsers.resolved_ids(tickers, found, "STK")) == [("AB", "2")]
    book = files.workbook({"One": spark.range(2), " two ": spark.range(3).withColumn("x", F.lit(1))})
    assert files.sheet_rows(book, "TWO").count() == 3
    with pytest.raises(ValueError, match="no sheet"):
        files.sheet_rows(book, "three")


def test_ledger_header_and_catalogue(spark, tmp_path):
    (tmp_path / "ledger.csv").write_text("id,status\n1,ok\n")
    assert rows(files.ledger(spark, str(tmp_path / "ledger.csv"), ["id", "status"])) == [("1", "ok")]
    with pytest.raises(ValueError, match="header"):
        files.ledger(spark, str(tmp_path / "ledger.csv"), ["id"])
    listed = files.catalogue(spark, str(tmp_path))
    assert files.report_path(listed, "ledg").endswith("ledger.csv") and files.file_named(listed, "x", required=False).isEmpty()
    with pytest.raises(ValueError, match="no files"):
        files.file_named(listed, "x")


def test_schema_check(spark):
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType

    assert files.validated(spark.range(1), StructType([StructField("id", LongType())])) == []
    assert files.validated(spark.range(1), StructType([StructField("id", IntegerType())])) == ["id: bigint for int"]
    with pytest.raises(ValueError, match="missing"):
        files.validated(spark.range(1), StructType([StructField("x", LongType())]))


def test_pipeline_runs_on_after_a_fault(spark, tmp_path):
    landed, published = tmp_path / "in", tmp_path / "out"
    landed.mkdir()
    (landed / "bonds_1.csv").write_text("a,b\n1,2\n")
    p = pipeline.Pipeline("market", (pipeline.Report("bonds", "bonds_", "bonds", lambda d: d.withColumn("c", F.lit("x")), "parquet"), pipeline.Report("etfs", "etfs_", "etfs"), pipeline.Report("old", "old_", "old")))
    out = pipeline.run(spark, p, str(landed), str(published), skip=["old"])
    assert (out.status, out.counts()) == ("partial", {"success": 1, "failed": 1, "skipped": 1})
    assert rows(spark.read.parquet(f"{published}/bonds")) == [("1", "2", "x")]
    with pytest.raises(ValueError, match="no pipeline"):
        pipeline.named([p], "x")


# --- documents ---


def test_protected_values_round_trip(spark):
    source = "Sr. Juan Pérez\npaga $1,000.50 el 12 de enero de 2024, ref AB12-99/X.\nfirmado digitalmente por X\nP<CRIDOE<<JANE<<<<<<<<<<<<<<<<<<<<<<<<<\nplain"
    df = documents.protected(spark.createDataFrame([(1, source), (2, None)], "id int, text string"))
    back = documents.restored(df, "protected").orderBy("id").collect()
    assert back[0]["restored"] == source and len(back[0]["values"]) >= 5 and "Juan" not in back[0]["protected"]
    broken = documents.restored(df.withColumn("t", F.lit("nothing")), "t").where("id = 1").first()
    assert broken["restored"] is None and "omitted" in broken["fault"]


def test_translation_memory_and_units(spark):
    pairs = spark.createDataFrame([(1, "hola\nuno 1\nadios", "hello\none 1\nbye"), (2, "Hola", "hi"), (3, "hola", "hello"), (4, "a\nb", "c")], "document_id int, source string, translated string")
    memory = documents.translation_memory(pairs).first()
    assert memory["glossary"] == "hola = hello\nadios = bye" and memory["entries"] == 2
    glossary = spark.createDataFrame([("hola", "hello")], "key string, target string")
    docs = spark.createDataFrame([(1, "uno\ndos\nHola\n12\ntres")], "document_id int, text string")
    got = [(r["text"], r["translate"]) for r in documents.translation_units(docs, glossary).orderBy("unit").collect()]
    assert got == [("uno\ndos", True), ("hello", False), ("12", False), ("tres", True)]


def test_document_quality(spark):
    schema = "document_id int, page_number int, text string, regions array<struct<text:string,confidence:double>>, image_quality double, defects array<struct<type:string,confidence:double>>"
    pages = spark.createDataFrame([(1, 2, "b" * 50, [("b", 0.9)], 0.3, None), (1, 1, "a" * 50, [("a", 0.9)], 0.9, []), (2, 1, None, None, None, None)], schema)
    got = {r["document_id"]: r for r in documents.document_quality(pages).collect()}
    assert got[1]["text"].startswith("aaa") and got[1]["status"] == "low" and got[1]["quality"]["status"] == "high"
    assert got[2]["status"] == "low" and got[2]["quality"]["reasons"] == ["no_text"]
    assert rows(documents.chunk_quality(spark.createDataFrame([(1, 15, 0.9), (1, 5, 0.5), (1, 2, None)], "document_id int, pages int, image_quality double"))) == [(1, 22, 0.8)]


def test_batches_to_do(spark):
    links = spark.createDataFrame([(i, i, f"2024{i:02d}") for i in range(6)], "id int, document_id int, created string")
    done = spark.createDataFrame([(1, "completed"), (2, "failed")], "document_id int, status string")
    ledger = spark.createDataFrame([(3, "failed", "document not found: 3"), (4, "failed", "time-out"), (5, "completed", None)], "document_id int, status string, error string")
    assert [r["id"] for r in documents.next_batch(links, done, ledger, 2).collect()] == [4, 2]


def test_decoded(spark):
    df = spark.createDataFrame([("aG9sYQ==", "text/plain"), ("!!", "text/plain"), ("6Q==", "text/plain"), ("aG9sYQ==", "image/png")], "data string, mime_type string")
    assert [r["plain"] for r in documents.decoded(df).collect()] == ["hola", None, "é", None]


# --- streams ---


def test_resumable_ledger(spark, tmp_path):
    source, ledger, checkpoint = (str(tmp_path / x) for x in ("in", "ledger", "check"))
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").write.parquet(source)
    work = lambda d: d.select("id", F.when(F.col("id") == 2, "failed").otherwise("completed").alias("status"))
    schema = "id int, v string"
    ledgers.resumable(ledgers.stream(spark, source, schema), "id", work, ledger, checkpoint).awaitTermination()
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], schema).write.mode("append").parquet(source)
    ledgers.resumable(ledgers.stream(spark, source, schema), "id", work, ledger, checkpoint).awaitTermination()
    assert rows(spark.read.parquet(ledger)) == [(1, "completed"), (2, "failed"), (2, "failed"), (3, "completed")]
