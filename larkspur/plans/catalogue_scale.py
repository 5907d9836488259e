"""Registered queries of what is made for tables that no one task holds: grid and interval joins, selection, places, sources, state, bucketed upserts."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from larkspur.operators import joins, ranks, tables
from larkspur.plans import documents, records
from larkspur.plans.catalogue import query, r, table
from larkspur.shared import path as shared_path
from larkspur.sources import parsers, workbooks
from larkspur.streaming import keyed, retries

#: Lines of a file that stands for a statement: more than a split holds, and not more than a task sorts at ease.
LINES_A_FILE = 4_000_000

# --- joins by containment ----------------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT l_orderkey // 64 AS page, (l_partkey * 37 % 9000) / 10.0 AS x, (l_suppkey * 53 + l_linenumber * 101) % 700 + 0.25 AS y, l_discount AS confidence FROM lineitem),
  p AS (SELECT o_orderkey, o_orderkey // 64 AS page, CAST(o_custkey % 800 AS DOUBLE) AS l, CAST(o_orderkey * 31 % 600 AS DOUBLE) AS t, CASE WHEN o_orderkey % 50 = 0 THEN 900.0 ELSE o_custkey % 90 + 5.0 END AS width, o_orderkey % 41 + 3.0 AS height FROM orders)
  SELECT o_orderkey AS paragraph_id, count(x) AS words, round(avg(confidence), 6) AS confidence FROM p LEFT JOIN w ON w.page = p.page AND x BETWEEN l AND l + width AND y BETWEEN t AND t + height GROUP BY o_orderkey""")
def word_paragraphs(spark, sf):
    """Lines stand for recognised words, orders for paragraphs, 64 order keys for a page; some paragraphs span the page."""
    point = lambda a, b: F.array(a, b)
    x, y = (F.col("l_partkey") * 37 % 9000) / 10, (F.col("l_suppkey") * 53 + F.col("l_linenumber") * 101) % 700 + 0.25
    words = table(spark, sf, "lineitem").select(F.floor(F.col("l_orderkey") / 64).alias("page"), F.col("l_discount").alias("confidence"), F.array(point(x - 2, y - 1), point(x + 2, y + 1)).alias("polygon"))
    key = F.col("o_orderkey")
    left, top = (F.col("o_custkey") % 800).cast("double"), (key * 31 % 600).cast("double")
    width, height = F.when(key % 50 == 0, F.lit(900.0)).otherwise(F.col("o_custkey") % 90 + 5.0), key % 41 + 3.0
    paragraphs = table(spark, sf, "orders").select(F.floor(key / 64).alias("page"), key.alias("paragraph_id"), F.array(point(left, top), point(left + width, top), point(left + width, top + height)).alias("polygon"))
    return documents.paragraph_confidences(words, paragraphs, ["page"]).select("paragraph_id", "words", r(F.col("confidence")).alias("confidence"))


@query("""WITH l AS (SELECT l_orderkey * 8 + l_linenumber AS low, l_orderkey * 8 + l_linenumber + l_quantity AS high FROM lineitem), o AS (SELECT o_orderkey, o_orderkey * 8 + 4 AS v FROM orders)
  SELECT o_orderkey, count(low) AS ranges, CAST(min(low) AS DOUBLE) AS first FROM o LEFT JOIN l ON v >= low AND v < high GROUP BY o_orderkey""")
def overlapping_ranges(spark, sf):
    """Each line is a range of its own, as many as there are lines."""
    low = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("double")
    spans = table(spark, sf, "lineitem").select(low.alias("low"), (low + F.col("l_quantity")).alias("high"))
    values = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * 8 + 4).alias("v"))
    met = joins.in_range(values, F.col("v"), spans, "low", "high")
    return met.groupBy("o_orderkey").agg(F.count("low").alias("ranges"), F.min("low").alias("first"))


# --- quantiles and places ----------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.05), 6) AS q05, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.9), 6) AS q90 FROM lineitem GROUP BY l_returnflag""")
def price_quantiles(spark, sf):
    """Few groups of many rows each: ranks are selected by counts of bins, whatever the size of a group."""
    found = ranks.quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.05, 0.5, 0.9])
    return found.select("l_returnflag", "n", *[r(F.col("q")[i]).alias(c) for i, c in enumerate(("q05", "median", "q90"))])


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey * 8 + l_linenumber) - 1 AS place, (row_number() OVER (ORDER BY l_orderkey * 8 + l_linenumber) - 1) // 500 AS batch FROM lineitem""")
def batches_of_lines(spark, sf):
    """Batches of 500 over the whole table, numbered by ranges of keys of some thousand rows."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"))
    placed = ranks.numbered(lines, "key", "place", rows_a_task=20_000)
    return placed.select("l_orderkey", "l_linenumber", F.col("place").cast("long").alias("place"), F.floor(F.col("place") / 500).alias("batch"))


# --- names of applications ---------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN ' M' || c_custkey || '@X.org' END AS mail, lower('first ' || c_mktsegment || ' ' || c_custkey % 50) AS name FROM customer),
  s AS (SELECT s_suppkey, 'm' || s_suppkey * 5 || '@x.org' AS mail, s_suppkey % 4 AS kind, lpad(CAST(s_suppkey % 7 AS VARCHAR), 2, '0') AS stamp FROM supplier),
  seg(i, seg) AS (VALUES (0, 'building'), (1, 'machinery'), (2, 'furniture')),
  n AS (SELECT s_suppkey, stamp, 'first ' || seg || ' ' || (s_suppkey + i) % 50 AS name FROM s JOIN seg ON kind = 2 OR (kind = 1 AND i < 2) OR (kind = 0 AND i = 0)),
  m AS (SELECT c_custkey, s_suppkey, stamp FROM c JOIN s ON lower(trim(c.mail)) = s.mail UNION SELECT c_custkey, s_suppkey, stamp FROM c JOIN n ON c.name = n.name)
  SELECT c_custkey AS contact_id, s_suppkey AS account_id FROM m QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY stamp DESC, s_suppkey) = 1""")
def account_by_application(spark, sf):
    """From application texts alone: one holder, two joint ones, three associates, or a type that is not known."""
    key, k = F.col("s_suppkey"), F.col("s_suppkey") % 4
    person = lambda i, seg: F.concat(F.lit('{"name":{"first":" Fírst","last":"'), F.lit(seg + " "), ((key + i) % 50).cast("string"), F.lit('"}}'))
    one, two, three = person(0, "Building"), person(1, "MACHINERY"), person(2, "Furniture")
    individual = F.concat(F.lit('"INDIVIDUAL","accountHolder":{"accountHolderDetails":['), one, F.lit(","), two, F.lit("]}"))  # the first counts
    joint = F.concat(F.lit('"joint","jointHolders":{"firstHolderDetails":['), one, F.lit('],"secondHolderDetails":['), two, F.lit("]}"))
    company = F.concat(F.lit('"ORGANIZATION","organization":{"associatedEntities":{"associatedIndividuals":['), F.concat_ws(",", one, two, three), F.lit("]}}"))
    other = F.concat(F.lit('"TRUST","accountHolder":{"accountHolderDetails":['), one, F.lit("]}"))
    body = F.when(k == 0, individual).when(k == 1, joint).when(k == 2, company).otherwise(other)
    application = F.concat(F.lit('{"customer":{"email":"m'), (key * 5).cast("string"), F.lit('@x.org","type":'), body, F.lit("}}"))
    accounts = table(spark, sf, "supplier").select(key.alias("id"), application.alias("application_json"), F.lpad((key % 7).cast("string"), 2, "0").alias("updated"), F.lit(None).cast("string").alias("created"))
    c = F.col("c_custkey")
    contacts = table(spark, sf, "customer").select(c.alias("id"), F.when(c % 5 == 0, F.concat(F.lit(" M"), c, F.lit("@X.org"))).alias("email"), F.concat_ws(" ", F.lit("First"), "c_mktsegment", (c % 50).cast("string")).alias("name"))
    return records.account_by_application(contacts, accounts)


# --- sources -----------------------------------------------------------------------------------------------------------


@query("""SELECT 'A' || l_orderkey AS account, 'Line ' || l_linenumber AS description, l_extendedprice AS amount FROM lineitem""")
def statement_of_many_accounts(spark, sf):
    """One statement in a few files, more of a larger table (a task writes a file), read by splits: the account of a row stands in an earlier line, perhaps in another split."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("Change in NAV,Data,Line "), "l_linenumber", F.lit(',"'), F.format_number("l_extendedprice", 2), F.lit('"')).alias("value"))
    heads = table(spark, sf, "lineitem").select("l_orderkey").distinct().select("l_orderkey", F.lit(0).cast("long").alias("l_linenumber"), F.concat(F.lit("Account Information,Data,Account,A"), "l_orderkey", F.lit(" (own)")).alias("value"))
    at = shared_path(spark, "statement")
    every = lines.withColumn("l_linenumber", F.col("l_linenumber").cast("long")).unionByName(heads)
    few = max(4, math.ceil(table(spark, sf, "lineitem").count() / LINES_A_FILE))
    every.repartitionByRange(few, "l_orderkey").sortWithinPartitions("l_orderkey", "l_linenumber").select("value").write.text(at)
    rows = parsers.statement_rows(parsers.ordered_lines(spark, at), None, F.lit("2024-01-31").cast("date"))
    return rows.select(F.col("Account").alias("account"), F.col("Description").alias("description"), F.col("Amount").alias("amount"))


@query("""SELECT CASE WHEN p_partkey % 3 = 0 THEN 'Bonds' ELSE 'Other & more' END AS sheet_name, CAST(p_partkey AS DOUBLE) AS id, p_name AS name, p_retailprice AS price, p_size > 25 AS large FROM part""")
def workbook_sheets(spark, sf):
    """Workbooks of a thousand parts, written by tasks and read again sheet by sheet."""
    at = shared_path(spark, "workbooks")
    part = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 1000).alias("book"), F.when(F.col("p_partkey") % 3 == 0, "Bonds").otherwise("Other & more").alias("sheet"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), (F.col("p_size") > 25).alias("large"))
    workbooks.published(part, "book", "sheet", at)
    spark.dataSource.register(workbooks.WorkbookSource)
    schema = "id double, name string, price double, large boolean, sheet_name string"
    return spark.read.format("workbook").schema(schema).load(at)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def rows_by_key(spark, sf):
    """Three runs of a stream by key: two of a third of the rows each, one of what is left."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    source, sink, checkpoint = (shared_path(spark, name) for name in ("keyed", "rows", "checkpoint"))
    orders.repartitionByRange(4, "o_orderkey").write.parquet(source)
    third, done = orders.count() // 3, None
    for most in (third, third, None):
        rows = keyed.next_rows(spark, source, "o_orderkey", most, done)
        rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        done = spark.read.parquet(sink)
    return done


# --- state and upserts -------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN value > 60 THEN 'completed' ELSE 'failed' END AS status FROM events),
  n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, status) AS n FROM e), f AS (SELECT * FROM n WHERE n <= 3 AND (status = 'completed' OR n = 3))
  SELECT user_id AS document_id, CAST(min(n) AS INT) AS attempts, CASE WHEN arg_min(status, n) = 'completed' THEN 'completed' ELSE 'failed' END AS outcome FROM f GROUP BY user_id""")
def attempt_outcomes(spark, sf):
    """Users stand for documents, events for attempts to process them: three tries at most."""
    attempts = table(spark, sf, "events").select(F.col("user_id").alias("document_id"), F.col("ts").alias("at"), F.when(F.col("value") > 60, "completed").otherwise("failed").alias("status"))
    return retries.outcomes_of_batch(attempts, 3)


@query("""WITH c AS (SELECT o_custkey, max(o_totalprice) AS price FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey), u AS (SELECT o_custkey + 1000000 AS c_custkey, price FROM c WHERE o_custkey % 10 = 0)
  SELECT c_custkey, c_name, coalesce(price, c_acctbal) AS c_acctbal FROM customer LEFT JOIN c ON o_custkey = c_custkey UNION ALL SELECT c_custkey, NULL, price FROM u""")
def bucketed_upsert(spark, sf):
    """Two upserts of a bucketed table: of balances, and of customers that were not there."""
    name = tables.unused("customers")
    tables.create(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), name, "c_custkey", 8)
    closed = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    known = closed.join(spark.table(name).select("c_custkey"), "c_custkey", "left_semi")
    tables.upsert(spark, name, known, "c_custkey", 8)
    added = closed.where("c_custkey % 10 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000)
    return tables.merged(spark, name, added, "c_custkey")
