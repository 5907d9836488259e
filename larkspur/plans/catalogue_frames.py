"""Registered queries of whole operators (frames in, frames out) that catalogue.py does not hold, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkspur import shared
from larkspur.fixed_values import ARCHETYPES, FATF_CODES, FORMULA_COLUMNS, HIGH_RISK, LOW_RISK, POSITION_COLUMNS, SANCTIONED, TICKET_BREAKS, TICKET_COLUMNS, WELL_REGULATED
from larkspur.operators import joins, selection, snapshots
from larkspur.plans import compliance, documents, pipeline, portfolio, quotes, records, reports
from larkspur.plans.catalogue import AS_OF, query, r, table
from larkspur.plans.catalogue_rules import choice, choice_sql, sql_in
from larkspur.sources import parsers
from larkspur.sources import reports as files


scratch = shared.path


# --- landed files ------------------------------------------------------------------------------------------------------


@query("SELECT 'clients_20240115.csv' AS folder, p_partkey, p_name AS name, p_retailprice AS price FROM part")
def landed_csv(spark, sf):
    """Published, catalogued, found by prefix, and read again."""
    base = scratch(spark, "landed")
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    files.published(rows, f"{base}/clients_20240115.csv", "csv")
    listed = files.catalogue(spark, base).withColumn("folder", F.element_at(F.split("path", "/"), -2)).where(F.col("name").endswith(".csv"))
    folder = listed.select("folder").distinct()
    back = files.csv(spark, f"{base}/clients_20240115.csv", "p_partkey bigint, name string, price double")
    return folder.crossJoin(back)  # one folder


@query("SELECT p_partkey, p_name AS name, p_size AS size FROM part")
def landed_json(spark, sf):
    path = scratch(spark, "landed")
    rows = table(spark, sf, "part").groupBy(F.floor(F.col("p_partkey") / 100)).agg(F.to_json(F.collect_list(F.struct("p_partkey", F.col("p_name").alias("name"), F.col("p_size").alias("size")))).alias("value"))
    rows.select("value").write.option("maxRecordsPerFile", 1).text(path)  # an array of a hundred rows in a file
    return files.json_array(spark, path, "p_partkey bigint, name string, size int")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'completed' ELSE 'failed' END AS status FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0")
def appended_ledger(spark, sf):
    path = scratch(spark, "ledger")
    done = table(spark, sf, "orders").where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("completed").alias("status"))
    files.appended(done, path)
    failed = table(spark, sf, "orders").where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("failed").alias("status"))
    files.appended(failed.join(spark.read.parquet(path), "o_orderkey", "left_anti"), path)
    return spark.read.parquet(path)


@query("""SELECT 'individual' AS kind, CAST(c_custkey AS VARCHAR) AS id, 'First ' || c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'Alias A|Alias B' ELSE '' END AS aliases, 'UN' AS source FROM customer WHERE c_custkey % 3 <> 0
  UNION ALL SELECT 'entity', CAST(c_custkey AS VARCHAR), c_name, '', 'UN' FROM customer WHERE c_custkey % 3 = 0""")
def un_list(spark, sf):
    path, key = scratch(spark, "list"), F.col("c_custkey")
    element = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    alias = lambda name: F.concat(F.lit("<INDIVIDUAL_ALIAS>"), element("ALIAS_NAME", F.lit(name)), F.lit("</INDIVIDUAL_ALIAS>"))
    person = element("INDIVIDUAL", F.concat(element("DATAID", key.cast("string")), element("FIRST_NAME", F.lit(" First ")), element("SECOND_NAME", F.col("c_name")), F.when(key % 2 == 0, F.concat(alias("Alias A"), alias(" "), alias("Alias B"))).otherwise("")))
    entity = element("ENTITY", F.concat(element("DATAID", key.cast("string")), element("FIRST_NAME", F.col("c_name"))))
    parts = table(spark, sf, "customer").groupBy(F.floor(key / 100)).agg(F.array_join(F.collect_list(F.when(key % 3 == 0, entity).otherwise(person)), "").alias("x"))
    parts.select(element("LIST", F.col("x")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)  # a list of a hundred names in a file
    return parsers.un_entries(spark, path)


@query("""SELECT p_partkey, p_name FROM part WHERE p_partkey % 2 = 0""")
def workbook_sheet(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    book = files.workbook({"Even ": part.where("p_partkey % 2 = 0"), "Odd": part.where("p_partkey % 2 = 1")})
    return files.sheet_rows(book, " even")


# --- parsers -----------------------------------------------------------------------------------------------------------


@query("""SELECT 'f' || (o_orderkey % 4) AS file, CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS kind FROM orders WHERE o_orderkey % 40 >= 8""")
def control_record_rows(spark, sf):
    k = F.col("o_orderkey") % 40
    spelled = F.when(k < 4, '"BOF",x').when(k < 8, "id,kind").otherwise(F.concat(F.lit('"'), "o_orderkey", F.lit('",'), "o_orderpriority"))
    body = table(spark, sf, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey") % 4).alias("file"), F.col("o_orderkey").alias("line"), spelled.alias("value"))
    heads = spark.range(4).select(F.concat(F.lit("f"), "id").alias("file"), F.lit(-1).cast("long").alias("line"), F.lit("id,kind").alias("value"))
    rows = parsers.control_record_report(body.unionByName(heads))
    return rows.select("file", "row").select("file", F.col("row")["id"].alias("id"), F.col("row")["kind"].alias("kind"))


@query(f"""WITH l AS (SELECT 'f' || (o_orderkey % 10) AS file, o_orderkey AS line, CASE WHEN o_orderkey % 50 < 10 THEN 'A' || ((o_orderkey // 50) % 3) END AS own, o_totalprice FROM orders),
  c AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY file ORDER BY line ROWS UNBOUNDED PRECEDING) AS account FROM l)
  SELECT DATE '{AS_OF}' AS "Date", 'D' || line AS "Description", round(o_totalprice, 2) AS "Amount", account AS "Account" FROM c WHERE own IS NULL AND account = 'A1' AND line % 7 <> 0""")
def statement_sections(spark, sf):
    key = F.col("o_orderkey")
    amount = F.when(key % 7 == 0, F.lit("")).otherwise(F.concat(F.lit('"'), F.format_number("o_totalprice", 2), F.lit('"')))
    own = F.concat(F.lit("Account Information,Data,Account,A"), (F.floor(key / 50) % 3).cast("string"), F.lit(" (Custom)"))
    value = F.when(key % 50 < 10, own).otherwise(F.concat(F.lit("Change in NAV,Data,D"), key, F.lit(","), amount))
    lines = table(spark, sf, "orders").select(F.concat(F.lit("f"), key % 10).alias("file"), key.alias("line"), value.alias("value"))
    return parsers.statement_rows(lines, "A1", F.lit(AS_OF).cast("date")).withColumn("Amount", F.round("Amount", 2))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS entity_number, CASE WHEN s_suppkey % 3 = 0 THEN ' Jane Doe ' || s_name WHEN s_suppkey % 3 = 1 THEN s_name || ', Jane' ELSE s_name END AS name FROM supplier""")
def ofac_names(spark, sf):
    key = F.col("s_suppkey")
    kind = choice(key, [" Individual ", "entity", "individual"])
    name = F.when(key % 3 == 0, F.concat("s_name", F.lit(", Jane Doe"))).when(key % 3 == 1, F.concat("s_name", F.lit(", Jane"))).otherwise(F.col("s_name"))
    blank = [F.lit(None).cast("string").alias(f"c{i}") for i in range(9)]
    part = table(spark, sf, "supplier").select(key.cast("string").alias("n"), name.alias("name"), kind.alias("kind"), *blank)
    out = parsers.ofac_entries([part.where("n % 2 = 0"), part.where("n % 2 = 1")])
    return out.select("entity_number", "name")


@query("""SELECT 'u' || (s_suppkey % 2) AS file, CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM supplier""")
def uk_list_rows(spark, sf):
    key = F.col("s_suppkey")
    body = table(spark, sf, "supplier").select(F.concat(F.lit("u"), key % 2).alias("file"), (key + 10).alias("line"), F.concat(F.lit('2024-01-01,"'), key, F.lit('",'), "s_name").alias("value"))
    heads = spark.range(4).select(F.concat(F.lit("u"), F.col("id") % 2).alias("file"), F.when(F.col("id") < 2, 0).otherwise(1).cast("long").alias("line"), F.when(F.col("id") < 2, "Report Date: 01-Jan-2024").otherwise("Last Updated,Unique ID,Name 6").alias("value"))
    rows = parsers.uk_entries(body.unionByName(heads))
    return rows.select("file", F.col("row")["Unique ID"].alias("id"), F.col("row")["Name 6"].alias("name"))


@query("""WITH f AS (SELECT 'S' || (c_custkey % 100) AS ticker, CASE WHEN c_custkey % 7 = 0 THEN 's' || (c_custkey % 100) ELSE 'X' || c_custkey END AS symbol, c_custkey // 100 AS place, CAST(c_custkey % 37 AS VARCHAR) AS conid FROM customer WHERE c_custkey % 3 <> 0),
  b AS (SELECT 'S' || s_suppkey AS ticker, s_suppkey AS n, arg_min(conid, {'i': upper(symbol) <> upper(ticker), 'p': place, 'c': conid}) AS conid FROM supplier JOIN f ON f.ticker = 'S' || s_suppkey GROUP BY s_suppkey)
  SELECT arg_min(ticker, {'n': n, 't': ticker}) AS ticker, conid FROM b GROUP BY conid""")
def resolved_ids(spark, sf):
    key = F.col("c_custkey")
    tickers = table(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("ticker"), F.col("s_suppkey").alias("n"))
    symbol = F.when(key % 7 == 0, F.concat(F.lit("s"), key % 100)).otherwise(F.concat(F.lit("X"), key))
    found = table(spark, sf, "customer").select(F.concat(F.lit("S"), key % 100).alias("ticker"), symbol.alias("symbol"), F.floor(key / 100).alias("place"), (key % 37).cast("string").alias("conid"), F.array(F.when(key % 3 == 0, "BOND").otherwise("STK")).alias("sections"))
    return parsers.resolved_ids(tickers, found, "STK")


@query("""SELECT CAST(l_partkey AS VARCHAR) AS conid, min(l_orderkey * 10 + l_linenumber) AS place FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""")
def watch_list(spark, sf):
    instruments = table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "R", "BOND").otherwise("STK").alias("assetClass"), F.col("l_partkey").alias("conid"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return parsers.watch_list_ids(instruments)


# --- quotes and reports ------------------------------------------------------------------------------------------------


@query(f"""SELECT CAST(p_partkey AS VARCHAR) AS "Conid", p_name AS "Ticker", round(CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_retailprice END, 2) AS "Last", CASE WHEN p_partkey % 3 = 0 THEN p_size / 2.0::DOUBLE END AS "Current Yield", '{AS_OF.replace("-", "")}000000' AS "Timestamp" FROM part""")
def equity_quotes(spark, sf):
    part = table(spark, sf, "part")
    last = F.when(F.col("p_size") % 4 == 0, "n/a").otherwise(F.concat(F.lit("C"), F.format_number("p_retailprice", 2)))
    good = part.select(F.col("p_partkey").cast("string").alias("conid"), F.col("p_name").alias("ticker"), last.alias("LAST_PRICE"))
    returns = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("conid"), (F.col("p_size") / 2).alias("average_return"))
    return quotes.equity_snapshot(good, F.lit(AS_OF).cast("date"), returns).select("Conid", "Ticker", F.round("Last", 2).alias("Last"), "Current Yield", "Timestamp")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS conid FROM part WHERE p_partkey % 6 = 0""")
def quotes_without_data(spark, sf):
    ids = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("conid"))
    return quotes.without_data(ids, ids.where("conid % 6 <> 0"))


@query("""WITH v AS (SELECT o_custkey AS conid, o_orderdate AS ts, arg_max(o_totalprice, o_orderkey) AS close FROM orders GROUP BY ALL), l AS (SELECT conid, max(ts) AS latest FROM v GROUP BY conid),
  a AS (SELECT v.conid, k, arg_max(close, ts) AS close FROM v JOIN l ON l.conid = v.conid, range(6) r(k) WHERE ts <= latest - to_years(k::INT) GROUP BY ALL),
  c AS (SELECT conid, close / lead(close) OVER (PARTITION BY conid ORDER BY k) - 1 AS change, count(*) OVER (PARTITION BY conid) AS n FROM a)
  SELECT conid, round(round_even(sum(change) / 5 * 100, 4), 3) AS average_return FROM c WHERE n = 6 GROUP BY conid""")
def five_year_returns(spark, sf):
    bars = table(spark, sf, "orders").select(F.col("o_custkey").alias("conid"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("close"), F.col("o_orderkey").alias("n"))
    return reports.average_annual_return(bars).select("conid", F.round("average_return", 3).alias("average_return"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y') AS "Year", strftime(o_orderdate, '%m') AS "Month" FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderdate BETWEEN '1997-02-01' AND '1997-08-15' ORDER BY o_orderdate DESC""")
def commission_rows(spark, sf):
    day = F.when(F.col("o_orderkey") % 11 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    rows = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy").alias("Year"), F.date_format("o_orderdate", "MM").alias("Month"), day.alias("TradeDate"))
    return reports.commissions(rows, "1997-02-01", "1997-08-15").select("o_orderkey", "Year", "Month")


@query("""SELECT o_custkey AS "Account", o_orderkey AS line, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 3) AS balance FROM orders""")
def running_balances(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("Account"), F.col("o_orderdate").alias("Date"), F.col("o_orderkey").alias("line"), F.col("o_totalprice").alias("Amount"))
    return reports.ending_balances(rows).select("Account", "line", F.round("balance", 3).alias("balance"))


@query("""SELECT account, 'several statements of ' || month AS fault FROM (SELECT 'A' || o_custkey AS account, strftime(o_orderdate, '%Y-%m') AS month FROM orders WHERE o_orderstatus = 'F') GROUP BY account, month HAVING count(*) > 1
  UNION ALL SELECT 'A' || c_custkey, 'no statement' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def statement_faults(spark, sf):
    name = F.concat(F.lit("A"), "o_custkey", F.lit("_"), F.date_format("o_orderdate", "yyyyMM"), F.when(F.col("o_orderkey") % 2 == 0, ".csv").otherwise(".CSV"))
    landed = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("path"), name.alias("name"))
    accounts = table(spark, sf, "customer").select(F.concat(F.lit("A"), "c_custkey").alias("account"))
    return parsers.statement_faults(parsers.statement_files(landed), accounts)


def _position(name: str):
    return {"Conid": F.col("l_partkey"), "Quantity": F.col("l_quantity"), "Symbol": F.concat(F.lit("P"), F.col("l_partkey")), "LevelOfDetail": F.when(F.col("l_linenumber") % 2 == 0, "LOT")}.get(name, F.lit(None).cast("string")).alias(name)


_POSITION_SQL = {"Conid": "CAST(l_partkey AS VARCHAR)", "Quantity": "CAST(l_quantity AS VARCHAR)", "Symbol": "'P' || l_partkey", "LevelOfDetail": "CASE WHEN l_linenumber % 2 = 0 THEN 'LOT' ELSE '' END"}


@query("SELECT " + ", ".join([f'{_POSITION_SQL.get(c, chr(39) * 2)} AS "{c}"' for c in POSITION_COLUMNS] + [f"'' AS \"{c} \"" if c in POSITION_COLUMNS else f"'' AS \"{c}\"" for c in FORMULA_COLUMNS]) + " FROM lineitem WHERE l_returnflag = 'R'")
def open_positions_template(spark, sf):
    lots = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    return reports.open_positions(lots.select(*[_position(c) for c in POSITION_COLUMNS]))


@query("""SELECT 'k: ' || l_orderkey AS line, count(*) AS n FROM lineitem GROUP BY 1""")
def ticket_lines(spark, sf):
    """The confirmation's lines that hold a symbol."""
    tickets = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).withColumn("Symbol", F.col("l_orderkey").cast("string"))
    message = reports.ticket_message(tickets)
    symbol = F.filter(F.split(message, "\n"), lambda x: x.startswith("Symbol: "))[0]
    return tickets.select(F.concat(F.lit("k: "), F.substring_index(symbol, ": ", -1)).alias("line"), "n")


# --- joins, records ----------------------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT c_custkey, ' p' || (c_custkey % 300) AS symbol FROM customer), f1 AS (SELECT 'P' || p_partkey AS s, p_partkey AS i FROM part WHERE p_partkey % 2 = 0), f2 AS (SELECT 'P' || p_partkey AS s, p_partkey AS i FROM part WHERE p_partkey % 3 = 0)
  SELECT c_custkey, CASE WHEN f1.i IS NOT NULL THEN 0 WHEN f2.i IS NOT NULL THEN 1 END AS feed, coalesce(f1.i, f2.i) AS id FROM w LEFT JOIN f1 ON f1.s = upper(trim(symbol)) LEFT JOIN f2 ON f2.s = upper(trim(symbol))""")
def first_matches(spark, sf):
    wanted = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit(" p"), F.col("c_custkey") % 300).alias("symbol"))
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("P"), "p_partkey").alias("Symbol"), F.lit("none").alias("Ticker"))
    feeds = [(part.where("id % 2 = 0"), ["Missing", "Ticker", "Symbol"]), (part.where("id % 3 = 0").withColumnRenamed("Symbol", "Name"), ["Ticker", "Name"])]
    got = joins.first_match(wanted, "symbol", feeds, "id")
    return got.select("c_custkey", "feed", F.get_json_object("match", "$.id").cast("long").alias("id"))


@query("""SELECT count(*) AS n, min(c_custkey) AS id FROM customer WHERE c_name = 'Customer#000000007'""")
def resolve_one(spark, sf):
    return joins.resolved(table(spark, sf, "customer").withColumnRenamed("c_custkey", "id"), F.col("c_name"), F.lit("Customer#000000007"))


@query("""SELECT DISTINCT c_custkey AS contact_id FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1998-10-03')""")
def contacts_to_screen(spark, sf):
    links = table(spark, sf, "customer").select(F.col("c_custkey").alias("contact_id"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_custkey")).alias("account_id"))
    screened = table(spark, sf, "orders").select(F.col("o_custkey").alias("contact_id"), F.date_format("o_orderdate", "yyyyMMddHHmmss").alias("created"))
    changed = snapshots.compared(links, links.where("contact_id > 5"))
    return compliance.to_screen(links, screened, F.lit("1998-10-03").cast("date"), [changed])


_CODES = ["IRN", "NGA", "USA", "CHE", "BRA", "", "fra"]
_KINDS = ["INDIVIDUAL", "JOINT", "Organization", "", "TRUST"]


@query(f"""WITH c AS (SELECT c_custkey AS id, {choice_sql("c_custkey", _KINDS)} AS t, {choice_sql("c_custkey // 5", _CODES)} AS country, c_custkey % 10 <> 9 AS linked, {choice_sql("c_custkey // 35", ["STK", "OPT", "CFD"])} AS product, c_custkey % 2 = 0 AS advised FROM customer),
  k AS (SELECT *, CASE upper(t) WHEN 'ORGANIZATION' THEN 'ORG' ELSE upper(t) END AS kind, upper(country) AS u FROM c),
  s AS (SELECT *, CASE kind WHEN 'ORG' THEN 5 WHEN 'JOINT' THEN 3 ELSE 1 END * 0.3 + CASE WHEN u = '' THEN 5 WHEN u IN {sql_in(SANCTIONED)} THEN 9 WHEN u IN {sql_in(HIGH_RISK)} THEN 7 WHEN u IN {sql_in(LOW_RISK)} THEN 1 WHEN u IN {sql_in(WELL_REGULATED)} THEN 3 ELSE 5 END * 0.25
    + CASE product WHEN 'STK' THEN 1 WHEN 'OPT' THEN 3 ELSE 7 END * 0.15 + 5 * 0.15 + CASE WHEN advised THEN 3 ELSE 1 END * 0.15 AS score, id % 25 = 0 AS listed, kind IN ('INDIVIDUAL', 'JOINT', 'ORG') AS known FROM k)
  SELECT id AS contact_id, CASE WHEN listed THEN 1 ELSE 0 END AS hits, CASE WHEN linked THEN kind ELSE '' END AS kind, CASE WHEN linked AND known THEN country ELSE '' END AS country, CASE WHEN linked AND known AND u IN {sql_in(FATF_CODES)} THEN 'Listed' END AS fatf_status,
    round(CASE WHEN linked AND known THEN CASE WHEN listed THEN greatest(9, score) ELSE score END END::DOUBLE, 6) AS risk_score,
    CASE WHEN NOT linked THEN 'linked account not found' WHEN NOT known THEN 'invalid customer type: ' || CASE WHEN kind = '' THEN 'missing' ELSE kind END END AS error FROM s WHERE id % 8 <> 0""")
def contact_screenings(spark, sf):
    """Every contact against three lists, with the risk of its account's application; contacts done before are left out."""
    key = F.col("c_custkey")
    customers = table(spark, sf, "customer")
    contacts = customers.select(key.alias("id"), F.col("c_name").alias("name"))
    links = customers.where(key % 10 != 9).select(key.alias("contact_id"), key.alias("account_id"), F.lit("20240102").alias("updated"), F.lit(None).cast("string").alias("created"))
    kind, country, product = choice(key, _KINDS), choice(F.floor(key / 5), _CODES), choice(F.floor(key / 35), ["STK", "OPT", "CFD"])
    # where the country lies depends on the type: legal residence, residence, or that of the first associated person
    person = F.format_string('"accountHolder":{"accountHolderDetails":[{"countryOfLegalResidence":"%s"}]}', country)
    joint = F.format_string('"jointHolders":{"firstHolderDetails":[{"residence":{"country":"%s"}}]}', country)
    company = F.format_string('"organization":{"associatedEntities":{"associatedIndividuals":[{"legalResidence":{"country":"%s"}}]}}', country)
    holder = F.when(kind == "INDIVIDUAL", person).when(kind == "JOINT", joint).otherwise(company)
    application = F.concat(F.lit('{"customer":{"type":"'), kind, F.lit('",'), holder, F.lit('},"accounts":[{"margin":"Cash","tradingPermissions":[{"product":"'), product, F.lit('"}]}]}'))
    accounts = customers.select(key.alias("id"), F.when(key % 2 == 0, key).otherwise(0).alias("advisor_code"), application.alias("application_json"))
    listed = customers.where(key % 25 == 0)
    ofac = listed.where(key % 3 == 0).select(key.alias("entity_number"), F.upper("c_name").alias("name"))
    uk = listed.where(key % 3 == 1).select(key.alias("Unique ID"), *[(F.col("c_name") if i == 6 else F.lit("")).alias(f"Name {i}") for i in range(1, 7)])
    un = listed.where(key % 3 == 2).select(key.alias("id"), F.lit("someone else").alias("name"), F.concat(F.lit("x|"), "c_name").alias("aliases"))
    done = customers.where(key % 8 == 0).select(key.alias("contact_id"))
    got = compliance.screenings(contacts, links, accounts, ofac, uk, un, done)
    hits = sum((F.coalesce(F.size(c), F.lit(0)) for c in ("uk", "un")), F.coalesce(F.size("ofac"), F.lit(0)))
    return got.select("contact_id", hits.alias("hits"), "kind", "country", "fatf_status", r(F.col("risk_score")).alias("risk_score"), "error")


@query("""WITH s AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' ELSE 'skipped' END AS status FROM events WHERE user_id % 3 <> 0 OR event_type <> 'purchase')
  SELECT user_id AS pipeline, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped,
    CASE WHEN count(*) FILTER (status = 'failed') = 0 THEN 'success' WHEN count(*) FILTER (status = 'success') > 0 THEN 'partial' ELSE 'failed' END AS status FROM s GROUP BY user_id""")
def step_reports(spark, sf):
    kind = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failed").otherwise("skipped")
    return records.status_report(table(spark, sf, "events").where("user_id % 3 <> 0 or event_type <> 'purchase'").select(F.col("user_id").alias("pipeline"), kind.alias("status")))


@query("""WITH f AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'clients' WHEN 1 THEN 'fees' ELSE 'other' END AS prefix, o_orderkey % 5 = 0 AS batch, o_orderdate = TIMESTAMP '1998-10-03' AS today FROM orders),
  n AS (SELECT count(*) FILTER (NOT batch AND today) AS n FROM f)
  SELECT 'p' || o_orderkey AS path, CASE prefix WHEN 'clients' THEN 'backup/clients.csv' ELSE 'fees/fees.csv' END AS target, CASE WHEN prefix = 'clients' THEN n ELSE 0 END AS replaced FROM f, n WHERE batch AND prefix <> 'other'""")
def backup_moves(spark, sf):
    key = F.col("o_orderkey")
    name = F.concat(choice(key, ["clients", "fees", "other"]), F.lit("_20240101.csv"))
    landed = table(spark, sf, "orders").select(F.concat(F.lit("p"), key).alias("path"), name.alias("name"), F.when(key % 5 == 0, "batch").otherwise("backup").alias("folder"), F.col("o_orderdate").alias("modified"))
    wanted = spark.createDataFrame([("clients", "backup", "clients.csv"), ("fees", "fees", "fees.csv")], "prefix string, backup_folder string, backup_name string")
    return records.backup_moves(landed, wanted, F.lit("1998-10-03").cast("date"))


@query("""SELECT 'list_' || strftime(o_orderdate, '%Y%m%d') || '_' || o_orderkey AS name, '1998-10-03' AS day FROM orders WHERE o_orderdate = TIMESTAMP '1998-10-03' ORDER BY name DESC LIMIT 1""")
def backup_of_day(spark, sf):
    name = F.concat(F.lit("list_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), "o_orderkey")
    return records.backup_of_day(table(spark, sf, "orders").select(name.alias("name")), "list_", F.lit("1998-10-03").cast("date"))


@query("""WITH a AS (SELECT DISTINCT json_object('event_type', event_type, 'user_id', user_id)::VARCHAR AS x FROM events WHERE CAST(ts AS DATE) = '2024-01-11'), b AS (SELECT DISTINCT json_object('event_type', event_type, 'user_id', user_id)::VARCHAR AS x FROM events WHERE CAST(ts AS DATE) = '2024-01-10'),
  p AS (SELECT * FROM a EXCEPT SELECT * FROM b), m AS (SELECT * FROM b EXCEPT SELECT * FROM a)
  SELECT (SELECT count(*) FROM p) AS added, (SELECT count(*) FROM m) AS removed, (SELECT string_agg(x, ';' ORDER BY x) FROM (SELECT x FROM p ORDER BY x LIMIT 3)) AS added_samples, (SELECT string_agg(x, ';' ORDER BY x) FROM (SELECT x FROM m ORDER BY x LIMIT 3)) AS removed_samples""")
def change_samples(spark, sf):
    day = lambda d: table(spark, sf, "events").where(F.col("ts").cast("date") == F.lit(d).cast("date")).select("user_id", "event_type")
    got = snapshots.change_summary(day("2024-01-11"), day("2024-01-10"))
    return got.select("added", "removed", *[F.array_join(c, ";").alias(c) for c in ("added_samples", "removed_samples")])


@query("""SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'Missing required fields: contact_id, recipient_email' WHEN 1 THEN 'recipient_source must be contact, ibkr, or testing' WHEN 2 THEN 'language must be en or es' WHEN 3 THEN 'missing_document_keys must be a non-empty array'
  WHEN 4 THEN 'missing_document_keys contains an unsupported document key' WHEN 5 THEN 'A review email cannot request both POI and POE' WHEN 6 THEN 'content.missing_documents is required' ELSE NULL END AS fault FROM customer""")
def request_faults(spark, sf):
    k = F.col("c_custkey") % 8
    keys = F.when(k == 3, F.array().cast("array<string>")).when(k == 4, F.array(F.lit("poi"), F.lit("zzz"))).when(k == 5, F.array(F.lit(" POI"), F.lit("poe"), F.lit("poe"))).otherwise(F.array(F.lit("poa")))
    content = F.struct(F.lit(False).alias("is_company_contact"), F.when(k != 6, F.array(F.lit("x"))).alias("missing_documents"))
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_custkey").alias("account_id"), F.when(k != 0, F.col("c_custkey")).alias("contact_id"), F.when(k == 0, " ").otherwise("a@x.org").alias("recipient_email"),
        F.when(k == 1, "guess").otherwise("contact").alias("recipient_source"), F.when(k == 2, "fr").otherwise("es").alias("language"), content.alias("content"), keys.alias("missing_document_keys"),
    )
    return records.request_faults(rows).select("c_custkey", "fault")


# --- portfolios --------------------------------------------------------------------------------------------------------

_ASSETS = [(f"p{i}", float(i)) for i in (2, 4, 9, 10, 15)]


@query(f"""WITH a(symbol, percentage) AS (VALUES {", ".join(f"('{s}', {p}::DOUBLE)" for s, p in _ASSETS)})
  SELECT symbol, round(percentage / sum(percentage) OVER (), 9) AS share, p_partkey AS id, p_brand AS brand FROM a JOIN part ON 'P' || p_partkey = upper(symbol)""")
def explicit_shares(spark, sf):
    assets = spark.createDataFrame(_ASSETS, "symbol string, percentage double")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("P"), "p_partkey").alias("Symbol"), F.col("p_brand").alias("brand"))
    got = portfolio.explicit_assets(assets, [part.where("id % 2 = 0"), part], "id")
    return got.select("symbol", F.round("share", 9).alias("share"), *[F.get_json_object("match", f"$.{c}").cast(t).alias(c) for c, t in (("id", "long"), ("brand", "string"))])


@query("""SELECT 'p' || p_partkey AS symbol, CASE WHEN p_partkey % 3 = 0 THEN 'own' ELSE p_brand END AS industry, CASE WHEN p_partkey % 5 <> 0 THEN p_size / 4.0::DOUBLE END AS coupon, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS maturity FROM part""")
def enriched_assets(spark, sf):
    key = F.col("p_partkey")
    none = F.lit(None)
    part = table(spark, sf, "part")
    assets = part.select(
        F.concat(F.lit("p"), key).alias("Symbol_x"), F.when(key % 3 == 0, "own").otherwise(" nan").alias("industry"), none.cast("double").alias("coupon"), none.cast("double").alias("years_to_maturity"), none.cast("double").alias("duration"), none.cast("string").alias("maturity"),
    )
    feed = part.select(key.alias("id"), F.concat(F.lit("P"), key).alias("Symbol"), F.col("p_brand").alias("Sector"), F.when(key % 5 != 0, (F.col("p_size") / 4).cast("string")).otherwise("none").alias("Coupon"), F.when(key % 2 == 0, F.col("p_type")).alias("Maturity"))
    return portfolio.enriched(assets, [feed], "id").select(F.col("Symbol_x").alias("symbol"), "industry", "coupon", "maturity")


@query("""WITH b AS (SELECT CASE p_size % 4 WHEN 0 THEN 'treasuries' WHEN 1 THEN 'bonds_bbb' WHEN 2 THEN 'etfs' ELSE 'bonds_bb' END AS bucket, p_retailprice / 100 AS y FROM part)
  SELECT bucket, count(*) AS n, round(avg(y), 6) AS average_yield, round(avg(y) * CASE bucket WHEN 'treasuries' THEN 0.25 WHEN 'bonds_bbb' THEN 0.5 WHEN 'etfs' THEN 0.25 ELSE 0 END, 6) AS contribution FROM b GROUP BY bucket""")
def proposal_summary(spark, sf):
    bucket = choice(F.col("p_size"), ["treasuries", "bonds_bbb", "etfs", "bonds_bb"])
    assets = table(spark, sf, "part").select(bucket.alias("bucket"), (F.col("p_retailprice") / 100).alias("Current Yield_x"))
    got = portfolio.summary(assets, {"treasuries": 0.25, "bonds_bbb": 0.5, "etfs": 0.25})
    return got.select("bucket", "n", r(F.col("average_yield")).alias("average_yield"), r(F.col("contribution")).alias("contribution"))


@query("""WITH y AS (SELECT median(CASE WHEN p_size / 20.0 <= 1 THEN p_size * 5.0 ELSE p_size / 20.0 END) AS m FROM part WHERE p_size > 0 AND p_partkey % 4 <> 0) SELECT p_name AS "Ticker", round(m, 6) AS current_yield, 'etfs' AS bucket FROM part, y WHERE p_partkey % 2 = 0""")
def etf_candidates(spark, sf):
    part = table(spark, sf, "part")
    equities = part.select(F.when(F.col("p_partkey") % 4 != 0, F.concat((F.col("p_size") / 20).cast("string"), F.lit("%"))).alias("Dividend Yield"), F.lit(" ").alias("yield"))
    etfs = part.where("p_partkey % 2 = 0").select(F.lit(None).cast("string").alias("Financial Instrument"), F.col("p_name").alias("Symbol"))
    return portfolio.etf_candidates(etfs, equities).select("Ticker", r(F.col("`Current Yield_x`")).alias("current_yield"), "bucket")


_WEIGHTS_SQL = ", ".join(f"({a[0]}, {', '.join(str(float(x)) for x in a[2:9])})" for a in ARCHETYPES)


@query(f"""WITH a(id, treasuries, bonds_aaa_a, bonds_bbb, bonds_bb, etfs, lo, hi) AS (VALUES {_WEIGHTS_SQL}), s AS (SELECT c_custkey, round((c_acctbal + 1000) / 1100, 3) AS score FROM customer),
  j AS (SELECT c_custkey, a.* FROM s JOIN a ON score >= lo AND (score < hi OR (score = hi AND hi = 10))), u AS (UNPIVOT j ON treasuries, bonds_aaa_a, bonds_bbb, bonds_bb, etfs INTO NAME bucket VALUE weight)
  SELECT c_custkey, bucket, round(CAST(weight AS DOUBLE) / sum(CAST(weight AS DOUBLE)) OVER (PARTITION BY c_custkey), 6) AS weight FROM u""")
def archetype_shares(spark, sf):
    scored = table(spark, sf, "customer").select("c_custkey", F.round((F.col("c_acctbal") + 1000) / 1100, 3).alias("score"))
    shares = portfolio.archetype_distribution(portfolio.with_archetype(scored, F.col("score")).where("archetype is not null"))
    return shares.select("c_custkey", "bucket", r(F.col("weight")).alias("weight"))


@query("""WITH p AS (SELECT *, p_partkey % 2 = 0 AS ust FROM part), c AS (SELECT p_partkey, p_brand || ' ' || p_name AS symbol, CASE WHEN p_partkey % 4 = 1 THEN p_name ELSE p_brand END AS ticker,
    CASE WHEN p_size % 3 = 0 THEN 'BBB' WHEN ust THEN 'UST' WHEN p_size % 3 = 1 THEN 'BB+' ELSE '' END AS rating, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size / 10.0 <= 1 THEN p_size * 10.0 ELSE p_size / 10.0 END AS y, CASE WHEN ust THEN 0 ELSE p_retailprice END AS price FROM p)
  SELECT symbol AS "Symbol_x", ticker AS "Ticker", rating AS "S&P Equivalent_x", round(y::DOUBLE, 4) AS current_yield, price FROM c WHERE y IS NOT NULL""")
def proposal_context(spark, sf):
    size, key = F.col("p_size"), F.col("p_partkey")
    part = table(spark, sf, "part")
    common = [
        F.concat_ws(" ", "p_brand", "p_name").alias("Financial Instrument"), F.when(size % 5 == 0, "").otherwise((size / 10).cast("string")).alias("Current Yield"),
        F.when(size % 3 == 0, "BBB").otherwise(" ").alias("S&P Equivalent"), F.when(key % 4 == 1, F.col("p_name")).alias("Issuer"),
    ]
    corporate = part.where("p_partkey % 2 = 1").select(*common, F.when(size % 3 == 1, "bb+").alias("SP"), F.col("p_retailprice").alias("price"))
    treasuries = part.where("p_partkey % 2 = 0").select(*common, F.lit("UST").alias("Sector"))
    got = portfolio.context(corporate, treasuries)
    return got.select("Symbol_x", "Ticker", "S&P Equivalent_x", F.round("`Current Yield_x`", 4).alias("current_yield"), "price")


@query("""SELECT c_mktsegment, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 3""")
def newest_of_each(spark, sf):
    return selection.top(table(spark, sf, "customer"), ["c_mktsegment"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_mktsegment", "c_custkey", "c_acctbal")


@query("""SELECT p_partkey, CAST((row_number() OVER (ORDER BY p_partkey) - 1) // 75 AS BIGINT) AS number FROM part""")
def quote_batches(spark, sf):
    """Batches are numbered over the whole table, by ranges of ids that one task can sort."""
    return selection.numbered_batches(table(spark, sf, "part").select("p_partkey"), 75, "p_partkey").select("p_partkey", F.col("batch").cast("long").alias("number"))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 4 <> 1 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 ORDER BY o_orderdate, o_custkey LIMIT 50""")
def translation_batches(spark, sf):
    """Customers stand for documents, orders for their processing; a ledger that holds a fault does not count as done."""
    orders, stamp = table(spark, sf, "orders"), F.date_format("o_orderdate", "yyyyMMdd")
    kept = orders.where("o_orderkey % 4 <> 1")
    done = F.when(F.col("o_orderstatus") == "O", "completed").otherwise("failed")
    processing = kept.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), done.alias("status"), F.lit("text_extraction").alias("process_type"), F.lit(None).cast("string").alias("updated"), stamp.alias("created"), F.lit("some text").alias("output_text"))
    ledger = table(spark, sf, "customer").select(F.col("c_custkey").alias("document_id"), F.lit("completed").alias("status"), F.lit(" ").alias("translated_text"))
    return documents.translation_batch(processing, ledger, 50).select(F.col("id").alias("o_orderkey"), F.col("document_id").alias("o_custkey"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'second' WHEN 1 THEN 'second' WHEN 2 THEN 'first' WHEN 3 THEN 'first' ELSE 'second' END AS matched FROM customer""")
def matched_people(spark, sf):
    """By name without the middle one, by e-mail, by the first of several, by none (the first), by name with the middle one."""
    k = F.col("c_custkey") % 5
    person = lambda first, middle, last, mail, tag: F.struct(F.lit(first).alias("firstName"), F.lit(middle).alias("middleName"), F.lit(last).alias("lastName"), F.lit(mail).alias("email"), F.lit(tag).alias("tag"))
    people = F.array(person("Ann", "B", "Cole", "ann@x.org", "first"), person("José", "Luis", "Díaz", "jose@x.org", "second"))
    first = F.when(k == 0, "JOSE").when(k == 2, "ann").when(k == 4, "josé luis").otherwise("nobody")
    last = F.when(k == 2, "cole").when(k.isin(0, 4), "Diaz").otherwise("known")
    mail = F.when(k == 1, " JOSE@x.org ").otherwise("")
    got = compliance.matched_person(people, first, F.lit(None).cast("string"), last, mail)
    return table(spark, sf, "customer").select("c_custkey", got["tag"].alias("matched"))


@query("""SELECT 'f' || o_orderkey AS path FROM orders WHERE o_orderkey % 9 = 4 ORDER BY o_orderdate DESC, 'positions_' || o_orderkey DESC LIMIT 1""")
def chosen_input(spark, sf):
    """No file has the exact name, so the newest with the prefix is taken."""
    name = F.when(F.col("o_orderkey") % 9 == 4, F.concat(F.lit("positions_"), "o_orderkey")).otherwise(F.concat(F.lit("other_"), "o_orderkey"))
    landed = table(spark, sf, "orders").select(F.concat(F.lit("f"), "o_orderkey").alias("path"), name.alias("name"), F.col("o_orderdate").alias("modified"))
    return spark.createDataFrame([(records.chosen_input(landed, "positions.csv", "positions_"),)], "path string")


_WEIGHTS = ", ".join(f"('{a[1]}', {', '.join(f'{float(x)}::DOUBLE' for x in a[2:9])})" for a in ARCHETYPES)
_OWN = {"cash": "CAST(10 * (c_custkey % 3) AS DOUBLE)", "treasuries": "20.0", "bonds": "CAST(50 - c_custkey % 7 AS DOUBLE)", "stocks": "CAST(15 + c_custkey % 11 AS DOUBLE)", "aaa": "40.0", "bbb": "35.0", "bb": "25.0"}
_DEFAULT = {
    "cash": "0.0", "treasuries": "floor(tr * 100 + 0.5)", "bonds": "floor(b * 100 + 0.5)", "stocks": "floor(e * 100 + 0.5)", "aaa": "CASE WHEN b <= 0 THEN 0 ELSE floor(aa / b * 100 + 0.5) END",
    "bbb": "CASE WHEN b <= 0 THEN 50 ELSE floor(bbb_w / b * 100 + 0.5) END", "bb": "CASE WHEN b <= 0 THEN 50 ELSE greatest(0, 100 - floor(aa / b * 100 + 0.5) - floor(bbb_w / b * 100 + 0.5)) END",
}
_SHOWN = ", ".join(f"CASE WHEN c_custkey % 2 = 0 THEN {_DEFAULT[k]} ELSE {_OWN[k]} END AS {k}" for k in portfolio.PLAN)
_PLANS_SQL = f"""WITH a(archetype, tr, aa, bbb_w, bb_w, e, lo, hi) AS (VALUES {_WEIGHTS}),
  s AS (SELECT c_custkey, a.*, aa + bbb_w + bb_w AS b FROM customer JOIN a ON round((c_acctbal + 1000) / 1100, 3) >= lo AND (round((c_acctbal + 1000) / 1100, 3) < hi OR (round((c_acctbal + 1000) / 1100, 3) = hi AND hi = 10))),
  p AS (SELECT *, {_SHOWN} FROM s),
  w AS (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN tr ELSE cash / 100 + treasuries / 100 END AS w1, CASE WHEN c_custkey % 2 = 0 THEN aa ELSE bonds / 100 * (aaa / 100) END AS w2, CASE WHEN c_custkey % 2 = 0 THEN bbb_w ELSE bonds / 100 * (bbb / 100) END AS w3,
    CASE WHEN c_custkey % 2 = 0 THEN bb_w ELSE bonds / 100 * (bb / 100) END AS w4, CASE WHEN c_custkey % 2 = 0 THEN e ELSE stocks / 100 END AS w5 FROM p),
  n AS (SELECT *, w1 + w2 + w3 + w4 + w5 AS t FROM w),
  plans AS (SELECT c_custkey, archetype, {", ".join(portfolio.PLAN)}, w1 / t AS w1, w2 / t AS w2, w3 / t AS w3, w4 / t AS w4, w5 / t AS w5 FROM n)"""


def _saved_plans(spark, sf):
    """Customers' scores give archetypes; every other customer has the archetype's default plan, the others one of their own."""
    key = F.col("c_custkey")
    scored = table(spark, sf, "customer").select("c_custkey", F.round((F.col("c_acctbal") + 1000) / 1100, 3).alias("score"))
    placed = portfolio.with_archetype(scored, F.col("score")).where("archetype is not null")
    default = portfolio.plan_columns({b: F.col(b) for b in portfolio.WEIGHTED})
    own = {"cash": (10 * (key % 3)).cast("double"), "treasuries": F.lit(20.0), "bonds": (50 - key % 7).cast("double"), "stocks": (15 + key % 11).cast("double"), "aaa": F.lit(40.0), "bbb": F.lit(35.0), "bb": F.lit(25.0)}
    plan = F.struct(*[F.when(key % 2 == 0, default[k]).otherwise(own[k]).alias(k) for k in portfolio.PLAN])
    return portfolio.plan_weights(placed.select("c_custkey", "archetype", plan.alias("plan")))


@query(_PLANS_SQL + f" SELECT c_custkey, archetype, {', '.join(f'CAST({k} AS DOUBLE) AS {k}' for k in portfolio.PLAN)}, round(w1, 9) AS w_treasuries, round(w2, 9) AS w_aaa, round(w3, 9) AS w_bbb, round(w4, 9) AS w_bb, round(w5, 9) AS w_etfs FROM plans")
def default_plans(spark, sf):
    """Plans of scored customers and the weights that proposals are made with: the archetype's own where the plan is its default."""
    plans = _saved_plans(spark, sf)
    weights = [F.round(F.col("weights")[b], 9).alias(f"w_{n}") for b, n in zip(portfolio.WEIGHTED, ("treasuries", "aaa", "bbb", "bb", "etfs"), strict=True)]
    return plans.select("c_custkey", "archetype", *[F.col("plan")[k].alias(k) for k in portfolio.PLAN], *weights)


_CANDIDATES_SQL = """r AS (SELECT 'T' || (p_partkey % 97) || '-' || (p_partkey % 6) AS tick, 'S' || p_partkey AS sym, p_size / 4.0 AS raw, (['bonds_aaa_a', 'bonds_bbb', 'bonds_bb', 'treasuries', '', ''])[1 + p_partkey % 6] AS bucket FROM part),
  c AS (SELECT tick, sym, bucket, CAST(CASE WHEN raw <= 1 THEN raw * 100 ELSE raw END AS DOUBLE) AS y FROM r WHERE CASE WHEN raw <= 1 THEN raw * 100 ELSE raw END BETWEEN 0.0001 AND 25),
  pr AS (SELECT bucket, median(y) AS m, mad(y) AS d, quantile_cont(y, 0.9) AS q90, count(*) AS n FROM c GROUP BY bucket), bo AS (SELECT bucket, n, greatest(0, m - 2.5 * greatest(d, 0.35)) AS lower, least(q90, m + 2.5 * greatest(d, 0.35)) AS upper FROM pr),
  x AS (SELECT c.*, n, y BETWEEN lower AND upper AS inside, count(*) FILTER (y BETWEEN lower AND upper) OVER (PARTITION BY c.bucket) AS k FROM c JOIN bo ON bo.bucket = c.bucket), kept AS (SELECT tick, sym, bucket, y FROM x WHERE inside OR k < greatest(3, least(5, n))),
  p2 AS (SELECT bucket, median(y) AS m, mad(y) AS d, quantile_cont(y, 0.75) AS q75, quantile_cont(y, 0.9) AS q90 FROM kept GROUP BY bucket),
  t2 AS (SELECT bucket, least(q75, m + 1.25 * greatest(d, 0.35)) AS target, greatest(least(q90, m + 2.5 * greatest(d, 0.35)) - greatest(0, m - 2.5 * greatest(d, 0.35)), 1) AS spread FROM p2),
  z AS (SELECT kept.*, greatest(0, 1 - abs(y - target) / spread) AS score, abs(y - target) AS distance FROM kept JOIN t2 ON t2.bucket = kept.bucket),
  o AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY bucket, tick ORDER BY score DESC, distance, y DESC, tick, sym) = 1),
  f AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, distance, y DESC, tick, sym) AS place FROM o)"""


def _candidates(spark, sf):
    k = F.col("p_partkey") % 6
    rating = F.when(k == 0, "AA+").when(k == 1, "BBB").when(k == 2, "BB-").when(k == 3, "UST").otherwise("B")
    part = table(spark, sf, "part").select(k.alias("k"), F.concat(F.lit("T"), F.col("p_partkey") % 97, F.lit("-"), k).alias("Ticker"), F.concat(F.lit("S"), "p_partkey").alias("Symbol"), (F.col("p_size") / 4).alias("Current Yield"), rating.alias("S&P Equivalent"))
    return portfolio.universe(part), part


@query(_PLANS_SQL.replace("WITH a(", f"WITH {_CANDIDATES_SQL}, a(") + """, need AS (SELECT c_custkey, unnest([{'b': 'treasuries', 'n': round_even(20 * w1, 0)}, {'b': 'bonds_aaa_a', 'n': round_even(20 * w2, 0)}, {'b': 'bonds_bbb', 'n': round_even(20 * w3, 0)}, {'b': 'bonds_bb', 'n': round_even(20 * w4, 0)}]) AS q FROM plans)
  SELECT c_custkey, bucket, tick AS "Ticker", sym AS "Symbol_x", y AS current_yield FROM need JOIN f ON f.bucket = q.b AND place <= q.n""")
def customer_proposals(spark, sf):
    """A proposal for each customer's plan, candidates ranked once; tickers belong to one bucket here (tests have shared ones)."""
    candidates = _candidates(spark, sf)[0]
    got = portfolio.proposals(candidates, _saved_plans(spark, sf).select("c_custkey", "weights"), "c_custkey")
    return got.select("c_custkey", "bucket", "Ticker", "Symbol_x", F.col("`Current Yield_x`").alias("current_yield"))


@query(f"WITH {_CANDIDATES_SQL.replace(chr(39) + 'bonds_bb' + chr(39), chr(39) * 2)}" + """, b AS (SELECT * FROM f WHERE bucket = 'bonds_bbb' AND place <= 10),
  l AS (SELECT 'bonds_bb' AS bucket, tick, sym, y FROM c WHERE bucket = '' AND tick NOT IN (SELECT tick FROM b) QUALIFY row_number() OVER (PARTITION BY tick ORDER BY y DESC, sym) = 1)
  SELECT bucket, tick AS "Ticker", sym AS "Symbol_x", y AS current_yield, CAST(1 AS INT) AS round FROM b
  UNION ALL SELECT * FROM (SELECT bucket, tick, sym, y, CAST(2 AS INT) FROM l ORDER BY y DESC, tick, sym LIMIT 10)""")
def left_over_proposal(spark, sf):
    """Nothing is rated BB, so half of the proposal comes from the left-over round, out of candidates without a known rating."""
    part = _candidates(spark, sf)[1].withColumn("S&P Equivalent", F.when(F.col("k") == 2, "B").otherwise(F.col("S&P Equivalent")))
    got = portfolio.proposal(portfolio.universe(part), {"bonds_bbb": 0.5, "bonds_bb": 0.5})
    return got.select("bucket", "Ticker", "Symbol_x", F.col("`Current Yield_x`").alias("current_yield"), "round")


_TICKET_SQL = {"Symbol": "CAST(l_orderkey AS VARCHAR)", "Quantity": "CAST(n AS VARCHAR)", "AssetClass": "'BOND'", "Issuer": "coalesce(flag, '')"}
_MESSAGE_SQL = " || ".join(f"'{c}: ' || {_TICKET_SQL.get(c, chr(39) * 2)} || {'chr(10) || chr(10)' if c in TICKET_BREAKS else 'chr(10)'}" for c in TICKET_COLUMNS)


@query(f"WITH t AS (SELECT l_orderkey, count(*) AS n, max(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END) AS flag FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, {_MESSAGE_SQL} AS message FROM t")
def ticket_messages(spark, sf):
    """The whole confirmation of each order, line by line; cells that are missing or null are empty."""
    tickets = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("Quantity"), F.max(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))).alias("Issuer"))
    shown = tickets.withColumn("Symbol", F.col("l_orderkey")).withColumn("AssetClass", F.lit("BOND"))
    return shown.select("l_orderkey", reports.ticket_message(shown).alias("message"))


@query("""SELECT 'raw' AS report, CAST(p_partkey AS VARCHAR) AS id, p_name AS name, CAST(NULL AS VARCHAR) AS size FROM part UNION ALL SELECT 'large', CAST(p_partkey AS VARCHAR), upper(p_name), CAST(p_size AS VARCHAR) FROM part WHERE p_size > 25""")
def piped_reports(spark, sf):
    """A pipeline of two reports: one published as it landed, one transformed; a third fails for want of its file and stops neither."""
    base = scratch(spark, "pipeline")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    files.published(part.select("id", "name"), f"{base}/landed/raw_20240115", "csv")
    files.published(part, f"{base}/landed/sizes_20240115", "csv")
    listed = files.catalogue(spark, f"{base}/landed").where(F.col("name").endswith(".csv"))
    named = files.published_reports(listed)
    large = lambda df: df.where(F.col("size").cast("int") > 25).withColumn("name", F.upper("name"))
    steps = (pipeline.Report("raw", "raw_", "raw", kind="parquet"), pipeline.Report("large", "sizes_", "large", large, "parquet"), pipeline.Report("gone", "fees_", "gone"))
    outcome = pipeline.run(spark, pipeline.named([pipeline.Pipeline("daily", steps)], "daily"), named, f"{base}/published")
    if outcome.status != "partial" or outcome.counts() != {"success": 2, "failed": 1, "skipped": 0} or not isinstance(outcome.faults["gone"], ValueError):
        raise ValueError(outcome)
    rows = {name: spark.read.parquet(f"{base}/published/{name}") for name in ("raw", "large")}
    differs = files.validated(rows["large"], StructType.fromDDL("id string, name string, size int"))  # raises where columns do
    if differs != ["size: string for int"]:
        raise ValueError(differs)
    return selection.union_tagged([(rows[name], {"report": name}) for name in rows], ["report"])


@query("""SELECT (SELECT 'p7' FROM orders WHERE o_orderkey = 7) AS named, (SELECT 'p' || o_orderkey FROM orders WHERE o_orderkey % 2 = 1 ORDER BY o_orderdate DESC, 'fees_' || o_orderkey || '.csv' DESC LIMIT 1) AS newest""")
def named_files(spark, sf):
    """A file by its whole name, and the last modified one with a prefix."""
    key = F.col("o_orderkey")
    name = F.concat(F.when(key % 2 == 1, "fees_").otherwise("nav_"), key, F.lit(".csv"))
    landed = table(spark, sf, "orders").select(F.concat(F.lit("p"), key).alias("path"), name.alias("name"), F.col("o_orderdate").alias("modified"))
    return spark.createDataFrame([(files.file_named(landed, "fees_7.csv").first()["path"], files.newest_path(landed, "fees_"))], "named string, newest string")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS document_id, p_name || ', "' || p_type || '"' AS note FROM part""")
def ledger_rows(spark, sf):
    """A ledger of files with one header each, with quotes and commas in its cells."""
    path = scratch(spark, "ledger")
    note = F.concat("p_name", F.lit(', "'), "p_type", F.lit('"'))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("document_id"), note.alias("note"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return files.ledger(spark, path, ["document_id", "note"])
