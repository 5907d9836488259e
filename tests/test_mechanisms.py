"""Workbooks, streams by key, attempts as state, bucketed upserts, carries over splits."""

from __future__ import annotations

import random
import zipfile
from datetime import datetime
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from larkspur.operators import joins, tables
from larkspur.plans import compliance, records
from larkspur.sources import parsers, workbooks
from larkspur.streaming import keyed, retries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- workbooks ---------------------------------------------------------------------------------------------------------


def styled_workbook(path):
    """Three sheets with shared texts, styles, formulas, errors, gaps and rich texts, as spreadsheet programs write them."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    texts = ["Name", "Fee", "When", "Ann & Co", "<b>", " kept ", "Paid"]
    fees = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c><c r="E1" t="s"><v>1</v></c></row>'
    fees += '<row r="2"><c r="A2" t="s"><v>3</v></c><c r="B2"><f>1+1</f><v>2</v></c><c r="C2" s="1"><v>45306.5</v></c><c r="E2" t="e"><v>#N/A</v></c></row><row r="3"/>'
    fees += '<row r="5"><c r="A5" t="s"><v>7</v></c><c r="B5"><v>-1.5</v></c><c r="C5" s="2"><v>45307</v></c><c r="E5"><v>7</v></c><c r="F5" t="b"><v>1</v></c></row>'
    mixed = '<row><c t="inlineStr"><is><t>Fee</t></is></c><c t="s"><v>6</v></c></row><row><c><v>3</v></c><c t="b"><v>0</v></c></row><row><c t="str"><v>free</v></c><c t="b"><v>1</v></c></row>'
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Fees" sheetId="1" r:id="a"/><sheet name="Other" sheetId="4" r:id="b"/><sheet name="Empty" sheetId="5" r:id="c"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/one.xml"/><Relationship Id="b" Target="/xl/worksheets/two.xml"/><Relationship Id="c" Target="worksheets/three.xml"/></Relationships>')
        items = "".join(f"<si><t>{escape(t)}</t></si>" for t in texts) + "<si><r><t>Be</t></r><r><t>th</t></r></si>"
        book.writestr("xl/sharedStrings.xml", f"<sst {main}>{items}</sst>")
        book.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="164"/></cellXfs></styleSheet>')
        for name, body in (("one", fees), ("two", mixed), ("three", "")):
            book.writestr(f"xl/worksheets/{name}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")


def test_three_sheets_of_a_workbook(spark, tmp_path):
    spark.dataSource.register(workbooks.WorkbookSource)
    styled_workbook(tmp_path / "book.xlsx")
    df = spark.read.format("workbook").load(str(tmp_path / "book.xlsx"))
    assert dict(df.dtypes) == {"Name": "string", "Fee": "string", "When": "timestamp_ntz", "column_4": "string", "Fee_2": "double", "column_6": "boolean", "Paid": "boolean", "sheet_name": "string"}
    assert df.rdd.getNumPartitions() == 3
    rows = {(r["sheet_name"], r["Fee"]): r for r in df.collect()}
    assert set(rows) == {("Fees", "2"), ("Fees", "-1.5"), ("Other", "3"), ("Other", "free")}
    first, second = rows["Fees", "2"], rows["Fees", "-1.5"]
    assert (first["Name"], first["When"], first["Fee_2"]) == ("Ann & Co", datetime(2024, 1, 15, 12), None)
    assert (second["Name"], second["When"], second["Fee_2"], second["column_6"]) == ("Beth", datetime(2024, 1, 16), 7.0, True)
    fees = spark.read.format("workbook").option("sheet", " fees ").load(f"file://{tmp_path}/book.xlsx")
    assert dict(fees.dtypes)["Fee"] == "double" and sorted(r["Fee"] for r in fees.collect()) == [-1.5, 2.0]
    assert spark.read.format("workbook").option("sheet", "Empty").load(str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="no sheet"):
        spark.read.format("workbook").option("sheet", "Gone").load(str(tmp_path)).count()


def test_published_workbooks_come_back(spark, tmp_path):
    data = [(b, s, i, f"<{i}> & é", None if i % 3 else i / 4, i % 2 == 0) for b in (1, 2) for s in ("x", "y\"'") for i in range(6)]
    df = spark.createDataFrame(data, "book int, sheet string, id int, name string, price double, even boolean")
    workbooks.published(df, "book", "sheet", f"{tmp_path}/books")
    back = spark.read.format("workbook").load(f"{tmp_path}/books").select("sheet_name", "id", "name", "price", "even")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(((s, float(i), n, p, e) for _, s, i, n, p, e in data), key=repr)


# --- streams -----------------------------------------------------------------------------------------------------------


def test_runs_by_key_read_each_row_once(spark, tmp_path):
    source, sink, checkpoint = (f"{tmp_path}/{n}" for n in ("source", "sink", "checkpoint"))
    keys = random.Random(1).sample(range(1000), 90)
    spark.createDataFrame([(k, f"r{k}") for k in keys], "id long, t string").repartition(3).write.parquet(source)

    def run(most, done, fail=False):
        rows = keyed.next_rows(spark, source, "id", most, done)
        if fail:
            rows = rows.withColumn("t", F.when(F.col("id") >= 0, F.raise_error(F.lit("stopped")).cast("string")))
        query = rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        if fail:
            with pytest.raises(Exception, match="(?i)stopped|exception"):
                query.awaitTermination()
        else:
            query.awaitTermination()
        return spark.read.schema("id long, t string").parquet(sink)

    done = run(25, None)
    assert sorted(r["id"] for r in done.collect()) == sorted(keys)[:25]
    run(25, done, fail=True)  # a stop in the middle of a batch loses none and repeats none
    done = run(25, done)
    assert sorted(r["id"] for r in done.collect()) == sorted(keys)[:50]
    spark.createDataFrame([(2000, "new")], "id long, t string").write.mode("append").parquet(source)
    done = run(None, done)
    assert sorted(r["id"] for r in done.collect()) == [*sorted(keys), 2000]


def test_attempts_as_state_equal_the_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(d, datetime(2024, 1, 1, 0, rng.randrange(60), i), rng.choice(("failed", "failed", "completed"))) for d in range(40) for i in range(rng.randrange(1, 6))]
    df = spark.createDataFrame(rows, "document_id long, at timestamp_ntz, status string")
    parts = sorted(rows, key=lambda r: r[1])
    for i in range(4):  # given in pieces, in the order of time
        spark.createDataFrame(parts[i * len(parts) // 4 : (i + 1) * len(parts) // 4], df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([(99, datetime(2024, 1, 1, 12), "failed")], df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")
        retries.outcomes(stream, 3, 60).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(store)
    got = {r["document_id"]: (r["attempts"], r["outcome"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {r["document_id"]: (r["attempts"], r["outcome"]) for r in retries.outcomes_of_batch(df, 3).collect()}
    assert {d: o for d, o in got.items() if o[1] != "overdue"} == want
    counts = {d: sum(r[0] == d for r in rows) for d in range(40)}
    assert {d: o for d, o in got.items() if o[1] == "overdue"} == {d: (n, "overdue") for d, n in counts.items() if d not in want}


# --- tables ------------------------------------------------------------------------------------------------------------


def test_upserts_leave_the_tables_side_where_it_is(spark):
    name = tables.unused("accounts")
    old = [(i, f"n{i}", float(i)) for i in range(200)]
    tables.create(spark.createDataFrame(old, "id long, name string, balance double"), name, "id", 8)
    changes = spark.createDataFrame([(5, 50.0), (5, 51.0), (300, 1.0), (None, 9.0), (7, None)], "id long, balance double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(tables.merged(spark, name, changes, "id"))
        own_side = text[text.index("SortMergeJoin") : text.index("FileScan")]  # the left child is printed first
        assert "Exchange" not in own_side and "Exchange" in text
        tables.upsert(spark, name, changes, "id", 8)
        tables.upsert(spark, name, spark.createDataFrame([(300, 2.0)], "id long, balance double"), "id", 8)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {i: (n, b) for i, n, b in old} | {5: ("n5", 51.0), 7: ("n7", None), 300: (None, 2.0)}
    assert {r["id"]: (r["name"], r["balance"]) for r in spark.table(name).collect()} == want
    spark.sql(f"DROP TABLE {name}")


def test_a_long_statement_over_many_splits(spark, tmp_path):
    rng, lines, want, account = random.Random(3), [], [], None
    for i in range(100_000):
        if rng.random() < 0.001 or not i:
            account = f"A{rng.randrange(10**6)}"
            lines.append(f"Account Information,Data,Account,{account} x")
        lines.append(f'Change in NAV,Data,d{i},"{i:,}.5"')
        want.append((account, f"d{i}", i + 0.5))
    (tmp_path / "statement.csv").write_text("﻿" + "\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        numbered = parsers.ordered_lines(spark, str(tmp_path / "statement.csv"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert numbered.select("part").distinct().count() > 8
    month = F.lit("2024-01-31").cast("date")
    rows = parsers.statement_rows(numbered, None, month)
    assert sorted((r["Account"], r["Description"], r["Amount"]) for r in rows.collect()) == sorted(want)
    one = want[50_000][0]
    assert parsers.statement_rows(numbered, one, month).count() == sum(a == one for a, *_ in want)


def test_carries_equal_the_window(spark):
    rng = random.Random(4)
    data = [(k, p, i, rng.choice((None, None, None, rng.randrange(9)))) for k in "ab" for p in range(6) for i in range(rng.randrange(7))]
    df = spark.createDataFrame(data, "k string, p int, i int, v int")
    whole = joins.carried(df, ["k"], [F.col("p"), F.col("i")], F.col("v"), "c")
    split = joins.carried_in_parts(df, ["k"], "p", [F.col("i")], F.col("v"), "c")
    assert sorted(map(tuple, split.select(whole.columns).collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)


# --- records -----------------------------------------------------------------------------------------------------------


def test_names_of_applications(spark):
    people = lambda *names: "[" + ",".join('{"name":{"first":"%s","last":"%s"}}' % n for n in names) + "]"  # noqa: E731, UP031
    rows = [
        (1, '{"customer":{"type":"individual","accountHolder":{"accountHolderDetails":%s}}}' % people(("José", "Díaz"), ("no", "one"))),  # noqa: UP031
        (2, '{"customer":{"type":"JOINT","jointHolders":{"firstHolderDetails":%s,"secondHolderDetails":%s}}}' % (people(("Ann", "")), people(("", "Lee")))),  # noqa: UP031
        (3, '{"customer":{"type":"ORGANIZATION","organization":{"associatedEntities":{"associatedIndividuals":%s}}}}' % people(*((f"P{i}", "X") for i in range(300)), ("P1", "x"), ("", " "))),  # noqa: UP031
        (4, '{"customer":{"type":"TRUST","accountHolder":{"accountHolderDetails":[]}}}'), (5, "not json"), (6, None), (7, '{"customer":{"type":"INDIVIDUAL"}}'),
    ]
    accounts = spark.createDataFrame(rows, "id long, application_json string")
    got = sorted(map(tuple, compliance.applicant_names(accounts, F.try_parse_json("application_json")).collect()))
    assert got == sorted([(1, "jose diaz"), (2, "ann"), (2, "lee"), *((3, f"p{i} x") for i in range(300))])


def test_answers_of_one_request_leave_others_alone(spark):
    prepared = spark.createDataFrame([(1, "F-1", "Prepared", None), (1, "F-2", "Prepared", None), (2, "F-1", "Prepared", None), (2, "F-9", "Skipped", "s")], "r int, form string, status string, message string")
    answers = spark.createDataFrame([(1, 1, "f1", "Done", "ok")], "r int, n int, form string, status string, message string")
    got = sorted((r["r"], r["form"], r["status"]) for r in records.merged_responses(prepared, answers, ("r",)).collect())
    assert got == [(1, "F-1", "Done"), (1, "F-2", "Prepared"), (2, "F-1", "Accepted"), (2, "F-9", "Skipped")]
    df = records.merged_responses(prepared, answers, ("r",))
    assert "Window" not in plan(df)
