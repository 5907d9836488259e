"""Registered queries, each on the driver's tables as stand-ins for the records an operator is made for, and their SQL.

Queries build on the library's functions and operators; the SQL beside each states the same result independently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.fixed_values import ARCHETYPES, HIGH_RISK, LOW_RISK, SANCTIONED, WELL_REGULATED
from larkspur.functions import bonds, dates, numbers, ocr, ratings, risk, text
from larkspur.operators import joins, profiles, selection, snapshots
from larkspur.plans import documents, portfolio, quotes, records, reports
from larkspur.sources import parsers
from larkspur.streaming import ledgers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
AS_OF = "2024-01-15"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c, digits: int = 6):
    return F.round(c, digits)


# --- scans, predicates, projections ------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def scan_filter_project(spark, sf):
    return selection.where_equal(table(spark, sf, "lineitem"), {"l_returnflag": "R", "l_linestatus": "F"}).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority = '1-URGENT'")
def predicate_map_in(spark, sf):
    return selection.where_equal(table(spark, sf, "orders"), {"o_orderstatus": ["F", "O"], "o_orderpriority": "1-URGENT", "user_id": 7}, ignore_unknown=True).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT * EXCLUDE (text) FROM documents")
def exclude_columns(spark, sf):
    return selection.without_columns(table(spark, sf, "documents"), ["text"])


@query('SELECT p_partkey AS "Ask Size", p_name AS "Company Name", p_brand AS "P_brand", p_retailprice AS "Last" FROM part')
def rename_capitalise(spark, sf):
    landed = table(spark, sf, "part").select(F.col("p_partkey").alias("ask size"), F.col("p_name").alias("company name"), "p_brand", F.col("p_retailprice").alias("last price"))
    return selection.capitalized(landed).withColumnsRenamed({"Ask size": "Ask Size", "Company name": "Company Name", "Last price": "Last"})


@query("SELECT CAST(p_partkey AS VARCHAR) AS symbol, p_retailprice AS last, CAST(NULL AS DOUBLE) AS bid FROM part")
def projection_with_defaults(spark, sf):
    quotes = table(spark, sf, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_retailprice").alias("last"))
    return selection.with_defaults(quotes, {"symbol": "string", "last": "double", "bid": "double"})


@query("SELECT event_id, ts, user_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")
def date_bounds(spark, sf):
    return selection.within_days(table(spark, sf, "events"), F.col("ts"), "2024-01-05", "2024-01-12").select("event_id", "ts", "user_id")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN 'quantity' WHEN l_discount = 0 THEN 'discount' END AS reason
  FROM lineitem WHERE l_quantity > 45 OR l_discount = 0""")
def validation_split(spark, sf):
    return selection.split_valid(table(spark, sf, "lineitem"), [(F.col("l_quantity") > 45, "quantity"), (F.col("l_discount") == 0, "discount")])[1].select("l_orderkey", "l_linenumber", "reason")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND (o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '2-%') THEN true ELSE false END AS terminal FROM orders""")
def terminal_failures(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", ((F.col("o_orderstatus") == "F") & selection.starts_with_any(F.col("o_orderpriority"), ("1-", "2-"))).alias("terminal"))


# --- latest rows, unions, sorts -----------------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark, sf):
    return selection.latest(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("""WITH f AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day FROM orders)
  SELECT o_orderkey, substr(day, 1, 4) AS "Year", substr(day, 5, 2) AS "Month", day AS "ReportDate" FROM f
  QUALIFY day = max(day) OVER (PARTITION BY substr(day, 1, 6))""")
def latest_per_month(spark, sf):
    files = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("account_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".csv")).alias("name"))
    day = dates.last_digits(F.col("name"))
    newest = selection.latest_files(files, day, [F.substring(day, 1, 6)])
    return newest.select("o_orderkey", F.substring(day, 1, 4).alias("Year"), F.substring(day, 5, 2).alias("Month"), day.alias("ReportDate"))


@query("""SELECT 'F' AS "Year", '01' AS "Month", o_orderkey, o_totalprice, NULL::VARCHAR AS o_orderpriority FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'O', '02', o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'""")
def union_tagged(spark, sf):
    orders = table(spark, sf, "orders")
    closed, others = orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus <> 'F'")
    return selection.union_tagged([(closed.select("o_orderkey", "o_totalprice"), {"Year": "F", "Month": "01"}), (others.select("o_orderkey", "o_totalprice", "o_orderpriority"), {"Year": "O", "Month": "02"})], ["Year", "Month"])


@query("""SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, o_orderdate, o_orderkey FROM orders ORDER BY 1 DESC, 2 DESC, 3 DESC, 4""")
def sort_multi_desc(spark, sf):
    rows = table(spark, sf, "orders").select(F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m"), "o_orderdate", "o_orderkey")
    return rows.orderBy(F.desc("y"), F.desc("m"), F.desc("o_orderdate"), "o_orderkey")


@query("SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1")
def keep_last_dedupe(spark, sf):
    days = table(spark, sf, "events").withColumn("day", F.col("ts").cast("date"))
    return selection.latest(days, ["user_id", "day"], [F.desc("ts"), F.desc("event_id")]).select("user_id", F.col("day").cast("string").alias("day"), "event_id")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user FROM conversations""")
def carry_forward(spark, sf):
    return joins.carried(table(spark, sf, "conversations"), ["conv_id"], [F.col("turn")], F.when(F.col("role") == "user", F.col("turn")), "last_user").select("conv_id", "turn", "last_user")


# --- joins --------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F' AND o_orderdate >= '2001-01-01')")
def anti_join_nullsafe(spark, sf):
    recent = table(spark, sf, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")))
    return table(spark, sf, "customer").join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice < 5000)")
def semi_join_zero(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_totalprice < 5000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("""WITH l AS (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
  SELECT c_custkey, n_name, r_name, o_orderkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN l ON o_custkey = c_custkey""")
def left_chain(spark, sf):
    newest = selection.latest(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")
    places = joins.small(table(spark, sf, "nation")).join(joins.small(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return table(spark, sf, "customer").join(joins.small(places), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(newest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "n_name", "r_name", "o_orderkey")


@query("""SELECT 'IBCID' || p_partkey AS "Symbol", l_orderkey, l_linenumber, l_quantity FROM (SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40) RIGHT JOIN part ON l_partkey = CAST(regexp_replace('IBCID' || p_partkey, '^IBCID', '') AS BIGINT)""")
def right_outer_prefixed_key(spark, sf):
    lots = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("Conid"), "l_orderkey", "l_linenumber", "l_quantity", F.when(F.col("l_returnflag") == "R", "BOND").otherwise("STK").alias("AssetClass"), F.when(F.col("l_quantity") > 40, "LOT").otherwise("SUMMARY").alias("LevelOfDetail"))
    quotes = table(spark, sf, "part").select(F.concat(F.lit("IBCID"), "p_partkey").alias("Symbol"))
    return reports.positions_with_quotes(lots, quotes).select("Symbol", "l_orderkey", "l_linenumber", "l_quantity")


_RANGES = ", ".join(f"({a[0]}, '{a[1]}', {float(a[7])}, {float(a[8])})" for a in ARCHETYPES)


@query(f"""WITH s AS (SELECT c_custkey, round((c_acctbal + 1000) / 1100, 3) AS score FROM customer), a(id, archetype, lo, hi) AS (VALUES {_RANGES})
  SELECT c_custkey, score, archetype FROM s LEFT JOIN a ON score >= lo AND (score < hi OR (score = hi AND hi = 10))""")
def range_join_archetype(spark, sf):
    scored = table(spark, sf, "customer").select("c_custkey", F.round((F.col("c_acctbal") + 1000) / 1100, 3).alias("score"))
    return portfolio.with_archetype(scored, F.col("score")).select("c_custkey", "score", "archetype")


_ANCHORS = [f"2024-01-{d:02d}" for d in (29, 24, 19, 14, 9, 4)]
_ANCHOR_SQL = ", ".join(f"({i}, TIMESTAMP '{d}')" for i, d in enumerate(_ANCHORS))


def _anchored(spark, sf):
    bars = table(spark, sf, "events").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return joins.as_of(bars, "user_id", "ts", "value", [(i, F.lit(d).cast("timestamp_ntz")) for i, d in enumerate(_ANCHORS)])


@query(f"""WITH a(anchor, at_ts) AS (VALUES {_ANCHOR_SQL}) SELECT user_id, anchor, arg_max(value, {{'t': ts, 'v': value}}) AS value FROM events JOIN a ON ts <= at_ts GROUP BY ALL""")
def asof_anchor(spark, sf):
    return _anchored(spark, sf)


@query(f"""WITH a(anchor, at_ts) AS (VALUES {_ANCHOR_SQL}), v AS (SELECT user_id, anchor, arg_max(value, {{'t': ts, 'v': value}}) AS value FROM events JOIN a ON ts <= at_ts GROUP BY ALL),
  p AS (SELECT user_id, value / nullif(lead(value) OVER (PARTITION BY user_id ORDER BY anchor), 0) - 1 AS change, count(*) OVER (PARTITION BY user_id) AS n FROM v)
  SELECT user_id, round(round_even(sum(change) / 5 * 100, 4), 3) AS average_return FROM p WHERE n = 6 GROUP BY user_id HAVING count(change) = 5""")
def annual_return(spark, sf):
    return joins.anchor_returns(_anchored(spark, sf), "user_id", "value", 6).where("average_return is not null").select("user_id", r(F.col("average_return"), 3).alias("average_return"))


@query("""WITH v AS (SELECT c_custkey, lower(regexp_replace(c_name, '[^A-Za-z0-9 ]+', ' ', 'g')) AS k FROM customer), l AS (SELECT s_suppkey, 'customer ' || substr(s_name, 10) AS k FROM supplier)
  SELECT c_custkey, 'list' AS source, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS hits FROM v JOIN l USING (k) GROUP BY c_custkey""")
def normalised_name_match(spark, sf):
    """The whole list; aliases vary with the supplier, so that a name's hits stay few at any scale."""
    people = table(spark, sf, "customer").select("c_custkey", "c_name")
    aliases = F.array(F.col("s_name"), F.concat(F.lit("CUSTOMER  "), F.substring_index("s_name", "#", -1)))
    listed = table(spark, sf, "supplier").select("s_suppkey", F.transform(aliases, lambda a: text.normalized_name(a)).alias("keys"))
    return joins.name_hits(people, "c_custkey", [text.normalized_name(F.col("c_name"))], listed, "s_suppkey", F.col("keys"), "list").withColumn("hits", F.array_join(F.col("hits").cast("array<string>"), ","))


@query("""SELECT w AS word, count(DISTINCT p_partkey) AS parts, min(p_partkey) AS first FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part) WHERE w <> '' GROUP BY w""")
def alias_explode_match(spark, sf):
    words = table(spark, sf, "part").select("p_partkey", F.explode(F.split(text.normalized_name(F.col("p_name")), " ")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.countDistinct("p_partkey").alias("parts"), F.min("p_partkey").alias("first"))


@query("""SELECT 'lineitem_part' AS relation, count(*) AS orphans FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)
  UNION ALL SELECT 'labels_documents', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en')""")
def integrity_fk(spark, sf):
    lines = joins.integrity(table(spark, sf, "lineitem"), "l_partkey", table(spark, sf, "part"), "p_partkey").agg(F.lit("lineitem_part").alias("relation"), F.count(F.lit(1)).alias("orphans"))
    labels = joins.integrity(table(spark, sf, "labels"), "doc_id", table(spark, sf, "documents").where("lang = 'en'"), "doc_id").agg(F.lit("labels_documents").alias("relation"), F.count(F.lit(1)).alias("orphans"))
    return lines.unionByName(labels)


@query("""SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer
  UNION ALL SELECT -c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 100 = 7""")
def upsert(spark, sf):
    base = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    changed = base.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    added = base.where("c_custkey % 100 = 7").withColumn("c_custkey", -F.col("c_custkey"))
    return joins.upserted(base, changed.unionByName(added), "c_custkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE o_orderpriority END AS o_orderpriority FROM orders
  WHERE o_orderkey <> (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'O')""")
def update_delete_first(spark, sf):
    changed = joins.updated(table(spark, sf, "orders"), F.col("o_orderstatus") == "F", {"o_orderpriority": F.lit("closed")})
    return joins.first_deleted(changed, F.col("o_orderstatus") == "O", "o_orderkey").select("o_orderkey", "o_orderpriority")


# --- aggregates, snapshots ----------------------------------------------------------------------------------------------


def _part(i: int) -> str:
    return f"CAST(sum(CAST('0x' || substr(h, {1 + 16 * i}, 16) AS UBIGINT)::HUGEINT) AS VARCHAR)"


@query(f"""WITH e AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, sha256(json_object('event_type', event_type, 'user_id', CAST(user_id AS VARCHAR))::VARCHAR) AS h FROM events)
  SELECT day, count(*) AS rows, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {", ".join(map(_part, range(4)))})) AS signature FROM e GROUP BY day""")
def snapshot_signature(spark, sf):
    rows = table(spark, sf, "events").select(F.col("ts").cast("date").cast("string").alias("day"), "user_id", "event_type")
    return snapshots.signature(rows, ("day",))


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE CAST(ts AS DATE) = '2024-01-11'), b AS (SELECT DISTINCT user_id FROM events WHERE CAST(ts AS DATE) = '2024-01-10')
  SELECT 'added' AS change, user_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'removed', user_id FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def snapshot_diff(spark, sf):
    day = lambda d: table(spark, sf, "events").where(F.col("ts").cast("date") == F.lit(d).cast("date")).select("user_id")
    return snapshots.differences(day("2024-01-11"), day("2024-01-10")).select("change", "user_id")


@query("""WITH a AS (SELECT user_id FROM events WHERE CAST(ts AS DATE) = '2024-01-11'), b AS (SELECT user_id FROM events WHERE CAST(ts AS DATE) = '2024-01-10')
  SELECT (SELECT count(*) FROM a) > 0 AS has_new, (SELECT count(*) FROM b) > 0 AS has_old, NOT EXISTS (SELECT user_id, count(*) FROM a GROUP BY 1 EXCEPT SELECT user_id, count(*) FROM b GROUP BY 1) AS is_same, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS added, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS removed""")
def snapshot_compare(spark, sf):
    day = lambda d: table(spark, sf, "events").where(F.col("ts").cast("date") == F.lit(d).cast("date")).select("user_id")
    return snapshots.compared(day("2024-01-11"), day("2024-01-10"))


@query("SELECT doc_id, greatest(quality, toxic) AS worst FROM documents LEFT JOIN labels USING (doc_id)")
def row_max_ignore_null(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", ratings.worse_level(F.col("quality"), F.col("toxic")).alias("worst"))


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) AS flags, bool_or(l_discount = 0) AS any_zero FROM lineitem GROUP BY l_orderkey")
def nunique_any(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_returnflag").alias("flags"), F.bool_or(F.col("l_discount") == 0).alias("any_zero"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'purchase') AS success, count(*) FILTER (event_type NOT IN ('error', 'purchase')) AS skipped FROM events GROUP BY user_id""")
def conditional_counts(spark, sf):
    kind = F.col("event_type")
    return table(spark, sf, "events").groupBy("user_id").agg(F.count_if(kind == "error").alias("failed"), F.count_if(kind == "purchase").alias("success"), F.count_if(~kind.isin("error", "purchase")).alias("skipped"))


_PROFILE = """p AS (SELECT p_brand, count(*) AS n, median(p_retailprice) AS median, mad(p_retailprice) AS mad, quantile_cont(p_retailprice, 0.75) AS q75, quantile_cont(p_retailprice, 0.9) AS q90 FROM part GROUP BY p_brand),
  b AS (SELECT *, greatest(0, median - 2.5 * greatest(mad, 0.35)) AS lower, least(q90, median + 2.5 * greatest(mad, 0.35)) AS upper, least(q75, median + 1.25 * greatest(mad, 0.35)) AS target FROM p)"""


@query(f"""WITH {_PROFILE} SELECT p_brand, n, round(median, 6) AS median, round(mad, 6) AS mad, round(q75, 6) AS q75, round(q90, 6) AS q90, round(lower, 6) AS lower, round(upper, 6) AS upper, round(target, 6) AS target FROM b""")
def robust_profile(spark, sf):
    return profiles.profile(table(spark, sf, "part"), ["p_brand"], "p_retailprice").select("p_brand", "n", *[r(F.col(c)).alias(c) for c in ("median", "mad", "q75", "q90", "lower", "upper", "target")])


_SCREEN = f"""{_PROFILE}, s AS (SELECT part.*, lower, upper, n, count(*) FILTER (p_retailprice BETWEEN lower AND upper) OVER (PARTITION BY part.p_brand) AS k FROM part JOIN b ON part.p_brand = b.p_brand),
  k AS (SELECT p_partkey, p_brand, p_type, p_retailprice FROM s WHERE k < greatest(3, least(5, n)) OR p_retailprice BETWEEN lower AND upper)"""


@query(f"WITH {_SCREEN} SELECT p_partkey, p_brand FROM k")
def outlier_screen(spark, sf):
    return profiles.screened(table(spark, sf, "part"), ["p_brand"], "p_retailprice").select("p_partkey", "p_brand")


@query(f"""WITH {_SCREEN}, p2 AS (SELECT p_brand, median(p_retailprice) AS m, mad(p_retailprice) AS d, quantile_cont(p_retailprice, 0.75) AS q75, quantile_cont(p_retailprice, 0.9) AS q90 FROM k GROUP BY p_brand),
  t AS (SELECT p_brand, least(q75, m + 1.25 * greatest(d, 0.35)) AS target, greatest(least(q90, m + 2.5 * greatest(d, 0.35)) - greatest(0, m - 2.5 * greatest(d, 0.35)), 1) AS spread FROM p2),
  c AS (SELECT k.*, round(greatest(0, 1 - abs(p_retailprice - target) / spread), 9) AS score FROM k JOIN t ON k.p_brand = t.p_brand),
  f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY score DESC, p_retailprice DESC, p_partkey) = 1)
  SELECT p_brand, p_type, p_partkey, round(score, 6) AS score FROM f QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_retailprice DESC, p_partkey) <= 5""")
def score_topk_bucket(spark, sf):
    kept = profiles.screened(table(spark, sf, "part"), ["p_brand"], "p_retailprice")
    best = profiles.scored(kept, ["p_brand"], "p_retailprice").withColumn("score", F.round("score", 9))
    order = [F.desc("score"), F.desc("p_retailprice"), "p_partkey"]
    firsts = selection.top(best, ["p_brand", "p_type"], order, 1)
    return selection.top(firsts, ["p_brand"], order, 5).select("p_brand", "p_type", "p_partkey", r(F.col("score")).alias("score"))


@query("""WITH s AS (SELECT c_mktsegment, sum(o_totalprice) AS w FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment) SELECT c_mktsegment, round(w / sum(w) OVER (), 6) AS weight FROM s""")
def distribution_normalise(spark, sf):
    spent = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return profiles.distribution(spent, "c_mktsegment", F.col("o_totalprice")).select("c_mktsegment", r(F.col("weight")).alias("weight"))


@query("""WITH n AS (SELECT c_mktsegment, CAST(round_even(20 * count(*) / sum(count(*)) OVER (), 0) AS INT) AS need FROM customer GROUP BY c_mktsegment)
  SELECT c_custkey, c.c_mktsegment, need FROM customer c JOIN n ON c.c_mktsegment = n.c_mktsegment QUALIFY row_number() OVER (PARTITION BY c.c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= need""")
def greedy_bucket_fill(spark, sf):
    customers = table(spark, sf, "customer")
    shares = profiles.distribution(customers, "c_mktsegment", F.lit(1.0)).select("c_mktsegment", numbers.half_even(20 * F.col("weight")).cast("int").alias("need"))
    return selection.top(customers.join(joins.small(shares), "c_mktsegment"), ["c_mktsegment"], [F.desc("c_acctbal"), "c_custkey"], F.col("need")).select("c_custkey", "c_mktsegment", "need")


# --- bonds --------------------------------------------------------------------------------------------------------------


def _instruments(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey", "p_brand", "p_type", (F.col("p_retailprice") / 10 + size - 25).alias("price"), (size / 10).alias("coupon"), F.date_add(F.lit(AS_OF).cast("date"), (size * 180).cast("int")).alias("maturity"), size.alias("size"),
    )


_INSTRUMENTS = f"i AS (SELECT p_partkey, p_brand, p_type, p_retailprice / 10 + p_size - 25 AS price, p_size / 10.0 AS coupon, DATE '{AS_OF}' + p_size * 180 AS maturity, p_size AS size FROM part)"
_CLUSTER = "CASE WHEN price < 0 THEN NULL WHEN price < 70 THEN 'Deep Discount' WHEN price < 95 THEN 'Discount' WHEN price < 105 THEN 'Par' WHEN price < 120 THEN 'Premium' ELSE 'High Premium' END"
_DURATION = "(list_sum(list_transform(range(1, n + 1), lambda j: coupon / 2 * pow(1 + coupon / price / 2, -j) * j / 2.0)) + 100 * pow(1 + coupon / price / 2, -n) * n / 2.0) / price"


@query(f"WITH {_INSTRUMENTS} SELECT p_partkey, {_CLUSTER} AS cluster FROM i")
def price_cluster(spark, sf):
    return _instruments(spark, sf).select("p_partkey", bonds.price_cluster(F.col("price")).alias("cluster"))


@query("SELECT l_orderkey, l_linenumber, coalesce(nullif(l_discount, 0), nullif(l_tax, 0), nullif(l_extendedprice, 0)) AS price FROM lineitem")
def first_valid_price(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", bonds.first_valid_price(F.col("l_discount"), F.col("l_tax"), F.col("l_extendedprice")).alias("price"))


@query(f"""WITH {_INSTRUMENTS} SELECT p_partkey, round(coupon / price, 9) AS cy, round((coupon + (100 - price) / (size * 180 * 86400 / (365.25 * 86400))) / ((100 + price) / 2), 9) AS ytm FROM i""")
def current_yield_ytm(spark, sf):
    i = _instruments(spark, sf)
    years = bonds.years_between(F.lit(AS_OF).cast("date"), F.col("maturity"))
    return i.select("p_partkey", r(bonds.current_yield(F.col("coupon"), F.col("price"), F.lit(0), F.lit(None)), 9).alias("cy"), r(bonds.yield_to_maturity(F.col("price"), F.col("coupon"), years), 9).alias("ytm"))


@query(f"WITH {_INSTRUMENTS}, n AS (SELECT *, greatest(1, CAST(floor(size * 180 / 360.0 * 2) AS INT)) AS n FROM i) SELECT p_partkey, round({_DURATION}, 6) AS duration FROM n")
def macaulay_duration(spark, sf):
    return _instruments(spark, sf).select("p_partkey", r(bonds.duration(F.col("maturity"), F.col("coupon") / 100, F.col("price"), F.lit(2), F.lit(AS_OF).cast("date"))).alias("duration"))


@query("""WITH f AS (SELECT p_partkey, lower(CASE p_size % 9 WHEN 0 THEN 'Annual' WHEN 1 THEN 'Semi-Annual' WHEN 2 THEN ' semi annual ' WHEN 3 THEN 'Quarterly' WHEN 4 THEN 'Monthly' WHEN 5 THEN 'Zero Coupon' WHEN 6 THEN 'Semi-Annually' WHEN 7 THEN '' ELSE p_type END) AS t FROM part)
  SELECT p_partkey, CASE trim(t) WHEN 'annual' THEN 1 WHEN 'semi-annual' THEN 2 WHEN 'semi annual' THEN 2 WHEN 'quarterly' THEN 4 WHEN 'monthly' THEN 12 WHEN 'zero' THEN 0 WHEN 'zero coupon' THEN 0
    ELSE CASE WHEN contains(t, 'annual') THEN 1 WHEN contains(t, 'quarterly') THEN 4 WHEN contains(t, 'monthly') THEN 12 WHEN contains(t, 'zero') THEN 0 ELSE 2 END END AS frequency FROM f""")
def payment_frequency(spark, sf):
    names = ["Annual", "Semi-Annual", " semi annual ", "Quarterly", "Monthly", "Zero Coupon", "Semi-Annually", ""]
    spelled = F.col("p_type")
    for i, name in enumerate(names):
        spelled = F.when(F.col("p_size") % 9 == i, F.lit(name)).otherwise(spelled)
    return table(spark, sf, "part").select("p_partkey", bonds.payment_frequency(spelled).alias("frequency"))


@query(f"""WITH {_INSTRUMENTS}, n AS (SELECT *, greatest(1, CAST(floor(size * 180 / 360.0 * 2) AS INT)) AS n, {_CLUSTER} AS cluster FROM i),
  d AS (SELECT *, round(coupon / price, 6) AS cy, round({_DURATION}, 6) AS duration, round((coupon + (100 - price) / (size * 180 / 365.25)) / ((100 + price) / 2), 6) AS ytm FROM n)
  SELECT p_brand, p_partkey, cluster, round(price, 6) AS price, cy, duration, ytm FROM d QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY ytm DESC, p_partkey) <= 10""")
def bond_report(spark, sf):
    i = _instruments(spark, sf)
    quotes = i.select(
        "p_partkey", "p_brand", F.lit(0.0).alias("Ask"), F.lit(None).cast("double").alias("Bid"), F.col("price").alias("Last"), F.lit(0.0).alias("Ask Size"), F.lit(0.0).alias("Bid Size"), F.col("coupon").alias("Coupon"),
        F.col("maturity").alias("Maturity"), F.lit("Semi-Annual").alias("Payment Frequency"), F.lit("BAA2/BBB (MOODY/SP)").alias("Ratings"), F.concat_ws(" ", "p_brand", "p_type").alias("Financial Instrument"),
    )
    out = reports.bond_analytics(quotes, F.lit(AS_OF).cast("date"))
    named = out.select("p_brand", "p_partkey", F.col("`Price Cluster`").alias("cluster"), r(F.col("Price")).alias("price"), r(F.col("CY")).alias("cy"), r(F.col("Duration")).alias("duration"), r(F.col("YTM")).alias("ytm"))
    return selection.top(named, ["p_brand"], [F.desc("ytm"), "p_partkey"], 10)


_SCALE = "['AAA','AA+','AA','AA-','A+','A','A-','BBB+','BBB','BBB-','BB+','BB','BB-','B+','B','B-','CCC+','CCC','CCC-','CC','C','D']"


@query(f"""WITH t AS (SELECT p_partkey, ({_SCALE})[1 + p_size % 22] AS sp, 1 + (p_size * 7) % 22 AS other FROM part)
  SELECT p_partkey, greatest(list_position({_SCALE}, sp), other) AS level, ({_SCALE})[greatest(list_position({_SCALE}, sp), other)] AS equivalent FROM t""")
def rating_equivalence(spark, sf):
    names = F.array(*[F.lit(x) for x in _SCALE.strip("[]").replace("'", "").split(",")])
    level = ratings.worse_level(ratings.rating_level(F.element_at(names, (1 + F.col("p_size") % 22).cast("int"))), (1 + (F.col("p_size") * 7) % 22).cast("int"))
    return table(spark, sf, "part").select("p_partkey", level.alias("level"), ratings.sp_equivalent(level).alias("equivalent"))


@query("""WITH t AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'BAA2/BBB (MOODY/SP)' WHEN 1 THEN 'CAA3 (MOODY)' WHEN 2 THEN 'NR' WHEN 3 THEN 'BB- (SP)' ELSE 'A1/A+ (SP/MOODY)' END AS x, p_size % 5 AS k FROM part)
  SELECT p_partkey, CASE k WHEN 0 THEN 'BAA2' WHEN 1 THEN 'CAA3' WHEN 4 THEN 'A+' END AS moodys, CASE k WHEN 0 THEN 'BBB' WHEN 3 THEN 'BB-' WHEN 4 THEN 'A1' END AS sp FROM t""")
def rating_text(spark, sf):
    k = F.col("p_size") % 5
    x = F.when(k == 0, "BAA2/BBB (MOODY/SP)").when(k == 1, "CAA3 (MOODY)").when(k == 2, "NR").when(k == 3, "BB- (SP)").otherwise("A1/A+ (SP/MOODY)")
    return table(spark, sf, "part").select("p_partkey", ratings.agency_ratings(x).alias("r")).select("p_partkey", "r.moodys", "r.sp")


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'GM CORP' WHEN 1 THEN 'US-T' WHEN 2 THEN 'ACME' ELSE 'PLAIN' END AS symbol, CASE p_size % 4 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN p_size + 0.25 WHEN 2 THEN 5.0 END::DOUBLE AS coupon,
  CASE p_size % 4 WHEN 0 THEN '2028-10-' || printf('%02d', 1 + p_size % 28) WHEN 1 THEN '2032-12-31' END AS maturity, CASE WHEN p_size % 4 = 0 THEN 'US37045VAS90' END AS isin, CASE WHEN p_size % 4 = 0 THEN 'BAA2/BBB' END AS ratings FROM part""")
def bond_description(spark, sf):
    size = F.col("p_size")
    whole = F.concat(F.lit("GM CORP "), size, F.lit(" 1/2% Oct"), F.lpad((1 + size % 28).cast("string"), 2, "0"), F.lit("'28 US37045VAS90 BAA2/BBB"))
    described = F.when(size % 4 == 0, whole).when(size % 4 == 1, F.concat(F.lit("US-T D08/26/13 12/31/2032 "), size, F.lit(".25%"))).when(size % 4 == 2, F.lit("ACME 5 NOTES")).otherwise("PLAIN PAPER")
    parsed = table(spark, sf, "part").select("p_partkey", size.alias("s"), bonds.bond_details(described).alias("d")).select("p_partkey", "s", "d.*")
    # what stands before a marked coupon holds the dates as well; the symbol is its first words here
    symbol = F.when(F.col("s") % 4 == 0, F.col("symbol")).otherwise(F.substring_index("symbol", " ", 1))
    return parsed.select("p_partkey", symbol.alias("symbol"), "coupon", "maturity", "isin", "ratings")


@query("""SELECT l_orderkey, sum(l_quantity) AS quantity, round(sum(l_extendedprice) / count(*), 6) AS price, round_even(round(sum(l_tax) + sum(l_extendedprice), 6), 2) AS total,
  CASE WHEN count(*) = 1 THEN 'single' ELSE 'consolidated' END AS type FROM lineitem GROUP BY l_orderkey""")
def ticket_consolidate(spark, sf):
    trades = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("Quantity"), F.col("l_tax").alias("AccruedInterest"), F.col("l_extendedprice").alias("NetCash"), F.col("l_extendedprice").alias("Price"), F.lit("GM CORP 5% Oct01'28").alias("Description"), F.col("l_linestatus").alias("Exchange"))
    out = reports.trade_ticket(trades, ["l_orderkey"], [F.col("l_linenumber")])
    return out.select("l_orderkey", F.col("Quantity").alias("quantity"), F.round("Price", 6).alias("price"), F.bround(F.round(F.col("AccruedInterest") + F.col("NetCash"), 6), 2).alias("total"), "type")


# --- dates, statements, accounts ----------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 50 AS INT) AS today FROM orders),
  b AS (SELECT o_orderkey, greatest(0, len(list_filter(range(CAST(d AS TIMESTAMP), CAST(today AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 1 DAY), lambda x: isodow(x) < 6)) - 1) AS business_days FROM o)
  SELECT o_orderkey, CAST(business_days AS INT) AS business_days, CAST(greatest(1, floor((business_days + 4) / 5)) AS INT) AS notice FROM b""")
def business_days_notice(spark, sf):
    opened = F.col("o_orderdate").cast("date")
    days = dates.business_days_since(opened, F.date_add(opened, (F.col("o_orderkey") % 50).cast("int")))
    return table(spark, sf, "orders").select("o_orderkey", days.alias("business_days"), dates.notice_number(days).alias("notice"))


@query("SELECT CAST(last_day(o_orderdate) AS VARCHAR) AS month_end, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def last_day_month(spark, sf):
    return table(spark, sf, "orders").groupBy(F.last_day("o_orderdate").cast("string").alias("month_end")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS description, round(o_totalprice, 2) AS amount FROM orders WHERE o_orderkey % 7 <> 0""")
def statement_parse(spark, sf):
    amount = F.when(F.col("o_orderkey") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit('"'), F.format_number("o_totalprice", 2), F.lit('"')))
    lines = table(spark, sf, "orders").select(F.concat_ws(",", F.lit("Change in NAV"), F.lit("Data"), "o_orderkey", amount).alias("value"), F.lit("f").alias("file"), (F.col("o_orderkey") + 1).alias("line"))
    parsed = lines.withColumn("cells", parsers.cells(F.col("value")))
    number = F.replace(F.element_at("cells", 4), F.lit(","), F.lit("")).try_cast("double")
    return parsed.where(F.element_at("cells", 4) != "").select(F.element_at("cells", 3).alias("description"), F.round(number, 2).alias("amount"))


@query(f"""WITH nav AS (SELECT o_custkey AS id, CASE WHEN o_totalprice < 20000 THEN 0 ELSE o_totalprice END AS total FROM orders WHERE o_orderdate >= '2001-01-01'),
  t AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT id FROM nav) UNION ALL SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_custkey IN (SELECT id FROM nav WHERE total = 0)),
  c AS (SELECT c_custkey AS id, DATE '2023-12-01' + CAST(c_custkey % 60 AS INT) AS opened FROM customer WHERE c_custkey % 3 <> 0),
  w AS (SELECT t.c_custkey, n_name, greatest(0, len(list_filter(range(CAST(opened AS TIMESTAMP), CAST(DATE '{AS_OF}' AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 1 DAY), lambda x: isodow(x) < 6)) - 1) AS d FROM t JOIN c ON c.id = t.c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey)
  SELECT CAST(c_custkey AS VARCHAR) AS account, 'c' || c_custkey || '@x.org' AS email, n_name AS advisor_email, CAST(d AS INT) AS business_days, CAST(greatest(1, floor((d + 4) / 5)) AS INT) AS notice_number FROM w""")
def unfunded_accounts(spark, sf):
    customers, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    accounts = customers.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_custkey").cast("string").alias("ibkr_account_number"), F.col("c_nationkey").alias("advisor_code"))
    recent = orders.where(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz"))
    nav = recent.select(F.col("o_custkey").cast("string").alias("ClientAccountID"), F.when(F.col("o_totalprice") < 20000, 0.0).otherwise(F.col("o_totalprice")).alias("Total"))
    clients = customers.select(F.col("c_custkey").cast("string").alias("Account ID"), F.when(F.col("c_custkey") % 3 != 0, "Open").otherwise("Closed").alias("Status"), F.date_add(F.lit("2023-12-01").cast("date"), (F.col("c_custkey") % 60).cast("int")).alias("Date Opened"))
    links = customers.select(F.col("c_custkey").cast("string").alias("account_id"), F.concat(F.lit("p"), "c_custkey").alias("contact_id"), F.lit("20240101000000").alias("updated"), F.lit("20230101000000").alias("created"))
    links = links.unionByName(links.withColumn("contact_id", F.lit("old")).withColumn("updated", F.lit("20230601000000")))
    nations = table(spark, sf, "nation")
    contacts = customers.select(F.concat(F.lit("p"), "c_custkey").alias("id"), F.concat(F.lit("c"), "c_custkey", F.lit("@x.org")).alias("email"), F.col("c_name").alias("name")).unionByName(nations.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("email"), F.col("n_name").alias("name")))
    advisors = nations.select(F.concat(F.lit("n"), "n_nationkey").alias("contact_id"), F.col("n_nationkey").alias("code"))
    return reports.unfunded_accounts(accounts, nav, clients, links, advisors, contacts, F.lit(AS_OF).cast("date"), ["nobody@x.org"]).select("account", "email", "advisor_email", "business_days", "notice_number")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS account, c_custkey || ' ' || CASE WHEN c_custkey % 2 = 0 THEN m.c_name ELSE c.c_name END AS alias FROM customer c LEFT JOIN (SELECT c_custkey AS k, c_name FROM customer) m ON m.k = c.c_custkey / 2 AND c.c_custkey % 2 = 0
  WHERE c_custkey % 4 < 2 AND c_custkey % 5 <> 0 AND (c_custkey % 2 = 1 OR m.c_name IS NOT NULL)""")
def alias_proposals(spark, sf):
    key = F.col("c_custkey")
    clients = table(spark, sf, "customer").select(
        key.cast("string").alias("Account ID"), F.when(key % 4 < 2, F.lit(" ")).otherwise(F.lit("taken")).alias("Alias"), F.when(key % 5 == 0, "Closed").when(key % 5 == 1, None).otherwise("Open").alias("Status"),
        F.col("c_name").alias("Title"), F.when(key % 2 == 0, (key / 2).cast("long").cast("string")).alias("Master Account"),
    )
    return reports.alias_proposals(clients)


# --- risk ---------------------------------------------------------------------------------------------------------------


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_CODES = ["IRN", "NGA", "USA", "CHE", "BRA", "", "fra"]
_CODE = "(['" + "','".join(_CODES) + "'])[1 + c_nationkey % 7]"
_JURISDICTION = f"CASE WHEN k = '' THEN 5 WHEN k IN {_in(SANCTIONED)} THEN 9 WHEN k IN {_in(HIGH_RISK)} THEN 7 WHEN k IN {_in(LOW_RISK)} THEN 1 WHEN k IN {_in(WELL_REGULATED)} THEN 3 ELSE 5 END"


def _code():
    return F.element_at(F.array(*[F.lit(c) for c in _CODES]), (1 + F.col("c_nationkey") % 7).cast("int"))


@query(f"WITH t AS (SELECT c_custkey, upper({_CODE}) AS k FROM customer) SELECT c_custkey, {_JURISDICTION} AS risk FROM t")
def jurisdiction_risk(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", risk.jurisdiction_risk(_code()).alias("risk"))


@query(f"""WITH t AS (SELECT c_custkey, upper({_CODE}) AS k, 1 + 2 * (c_custkey % 4) AS c FROM customer)
  SELECT c_custkey, round(CAST(CASE WHEN c_custkey % 11 = 0 THEN greatest(9, s) ELSE s END AS DOUBLE), 6) AS risk FROM (SELECT c_custkey, least(10, greatest(1, c * 0.3 + ({_JURISDICTION}) * 0.25 + 3 * 0.15 + 5 * 0.15 + (CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 3 END) * 0.15)) AS s FROM t)""")
def weighted_risk(spark, sf):
    key = F.col("c_custkey")
    score = risk.weighted_risk(1 + 2 * (key % 4), risk.jurisdiction_risk(_code()), F.lit(3), risk.introducer_risk(F.when(key % 2 == 1, key)), listed=key % 11 == 0)
    return table(spark, sf, "customer").select("c_custkey", r(score).alias("risk"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) AS k FROM events")
def json_path_fallback(spark, sf):
    return table(spark, sf, "events").select("event_id", risk.json_text(F.try_parse_json("props"), "$.missing", "$.k").alias("k"))


# --- records, quotes ----------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'missing master account' END AS fault FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND c_custkey <> 12""")
def missing_details(spark, sf):
    key = F.col("c_custkey")
    accounts = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit(" "), key).alias("ibkr_account_number"), F.when(key % 2 == 0, F.lit("M")).alias("master_account"))
    details = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("account_id"))
    return records.missing_details(accounts, details, ("12",)).select("c_custkey", "fault")


@query("""WITH l AS (SELECT l_orderkey, arg_max(l_linestatus, {'n': l_linenumber, 's': l_linestatus, 'm': l_returnflag}) AS s, arg_max(l_returnflag, {'n': l_linenumber, 's': l_linestatus, 'm': l_returnflag}) AS m FROM lineitem WHERE l_quantity > 45 GROUP BY l_orderkey),
  o AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'Skipped' WHEN l.s IS NOT NULL THEN l.s ELSE 'Prepared' END AS status FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
  SELECT o_orderkey, CASE WHEN status = 'Prepared' AND bool_and(status IN ('Prepared', 'Skipped')) OVER (PARTITION BY o_custkey) THEN 'Accepted' ELSE status END AS status, CASE WHEN o_orderstatus <> 'P' THEN m END AS message FROM o""")
def merged_responses(spark, sf):
    """A customer's orders are the forms of one request."""
    orders = table(spark, sf, "orders")
    prepared = orders.select("o_custkey", "o_orderkey", F.concat(F.lit("F-"), "o_orderkey").alias("form"), F.when(F.col("o_orderstatus") == "P", "Skipped").otherwise("Prepared").alias("status"), F.lit(None).cast("string").alias("message"))
    answers = table(spark, sf, "lineitem").where("l_quantity > 45").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    responses = answers.select("o_custkey", F.concat(F.lit("f"), "l_orderkey").alias("form"), F.col("l_linenumber").alias("n"), F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("message"))
    return records.merged_responses(prepared, responses, ("o_custkey",)).select("o_orderkey", "status", "message")


@query("""WITH c AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL) SELECT count(*) FILTER (h IS NOT NULL) AS hits, count(DISTINCT sha256(text)) FILTER (h IS NULL) AS to_do FROM documents LEFT JOIN c ON h = sha256(text) WHERE text IS NOT NULL""")
def result_cache(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", "text")
    cache = docs.where("doc_id % 3 = 0").select(records.cache_key(F.col("text"), "v1").alias("key")).distinct()
    hits, todo = records.cached(docs, "text", "v1", cache)
    return hits.agg(F.count(F.lit(1)).alias("hits")).crossJoin(todo.agg(F.count(F.lit(1)).alias("to_do")))  # one row each


@query("""SELECT count(*) AS links, count(DISTINCT d.doc_id) AS documents, count(*) FILTER (quality = 1) AS done, count(*) FILTER (quality = 0) AS failed, count(*) FILTER (quality IS NULL OR quality = 0) AS to_do FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def population_counts(spark, sf):
    processing = table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"), F.when(F.col("quality") == 1, "completed").otherwise("failed").alias("status"))
    return records.population(table(spark, sf, "documents").select(F.col("doc_id").alias("document_id")), processing)


@query("""WITH p AS (SELECT c_custkey, lower(c_mktsegment) AS name, CASE WHEN c_custkey % 4 = 0 THEN 'm' || c_custkey ELSE '' END AS mail FROM customer),
  a AS (SELECT s_suppkey, 'm' || s_suppkey AS mail, CASE WHEN s_suppkey % 5 = 0 THEN 'building' ELSE 'x' END AS name, lpad(CAST(s_suppkey % 7 AS VARCHAR), 2, '0') AS stamp FROM supplier),
  m AS (SELECT c_custkey, s_suppkey, stamp FROM p JOIN a ON p.mail = a.mail AND p.mail <> '' UNION SELECT c_custkey, s_suppkey, stamp FROM p JOIN a ON p.name = a.name)
  SELECT c_custkey AS contact_id, s_suppkey AS account_id FROM m QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY stamp DESC, s_suppkey) = 1""")
def account_by_contact(spark, sf):
    key = F.col("c_custkey")
    contacts = table(spark, sf, "customer").select(key.alias("id"), F.when(key % 4 == 0, F.concat(F.lit("M"), key)).alias("email"), F.col("c_mktsegment").alias("name"))
    accounts = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("m"), "s_suppkey").alias("email"), F.array(F.when(F.col("s_suppkey") % 5 == 0, "Building").otherwise("x")).alias("names"), F.lpad((F.col("s_suppkey") % 7).cast("string"), 2, "0").alias("updated"), F.lit(None).cast("string").alias("created"))
    return records.account_by_contact(contacts, accounts)


@query("""SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN 'error' WHEN p_partkey % 10 = 0 THEN 'unmatched conid' WHEN p_size % 6 = 1 THEN 'missing identity' END AS reason FROM part WHERE p_size % 6 IN (0, 1) OR p_partkey % 10 = 0""")
def snapshot_identity(spark, sf):
    part = table(spark, sf, "part")
    wire = part.select("p_partkey", F.concat("p_partkey", F.lit("@X")).alias("conidEx"), F.when(F.col("p_size") % 6 != 1, F.col("p_name")).alias("55"), F.when(F.col("p_size") % 6 == 0, "late").alias("error"))
    ids = part.where("p_partkey % 10 <> 0").select(F.col("p_partkey").cast("string").alias("conid"), F.col("p_name").alias("ticker"))
    return quotes.identified(quotes.named_fields(wire), ids)[1].select("p_partkey", "reason")


@query("""SELECT p_partkey, round(CASE WHEN p_size % 5 = 0 THEN NULL ELSE 1000 * (p_size / 10.0) / CAST(replace(printf('%.2f', p_retailprice), '.', '') AS DOUBLE) * 100 END, 8) AS parity, round(CASE WHEN p_size % 5 = 0 THEN NULL ELSE 100 * (p_size / 10.0) / CAST(printf('%.2f', p_retailprice) AS DOUBLE) END, 8) AS corrected FROM part""")
def treasury_yields(spark, sf):
    last = F.when(F.col("p_size") % 5 == 0, F.lit("0")).otherwise(F.format_string("%.2f", F.col("p_retailprice")))
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 10).alias("Coupon"), last.alias("Last"))
    both = quotes.bond_snapshot(rows, treasury=True).withColumnRenamed("Current Yield", "a").withColumn("b", bonds.treasury_yield(F.col("Coupon"), F.col("Last"), parity=False))
    return both.select("p_partkey", r(F.col("a"), 8).alias("parity"), r(F.col("b"), 8).alias("corrected"))


# --- documents ----------------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT doc_id, coalesce(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '') AS p FROM documents),
  v AS (SELECT doc_id, length(p) AS chars, regexp_replace(p, '[\\x09-\\x0D\\x{85}]|\\pZ', '', 'g') AS v FROM t),
  n AS (SELECT doc_id, chars, length(v) AS n, length(v) - length(regexp_replace(v, '\\pC|\\pZ', '', 'g')) AS odd, length(v) - length(regexp_replace(v, '\\pC|\\x{FFFD}', '', 'g')) AS bad FROM v),
  s AS (SELECT doc_id, CASE WHEN chars = 0 THEN 0 ELSE 0.85 * 65 + (1 - odd / greatest(1, n)) * 20 + least(10, n / 4) + (1 - bad / greatest(1, n)) * 5 END AS score FROM n)
  SELECT doc_id, round(score::DOUBLE, 6) AS score, CASE WHEN score >= 80 THEN 'high' WHEN score >= 50 THEN 'review' ELSE 'low' END AS status FROM s""")
def ocr_text_score(spark, sf):
    none = F.lit(0)
    return table(spark, sf, "documents").select("doc_id", ocr.assessed(F.col("text"), F.lit(None).cast("double"), F.lit(1), none, none, none).alias("a")).select("doc_id", r(F.col("a.score")).alias("score"), "a.status")


@query("""SELECT sha1(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def duplicate_groups(spark, sf):
    return snapshots.duplicate_groups(table(spark, sf, "documents").where("text is not null"), F.col("text"), "doc_id")


@query("SELECT d.doc_id, source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND quality = 1 WHERE l.doc_id IS NULL ORDER BY d.doc_id DESC LIMIT 100")
def unprocessed_batch(spark, sf):
    done = table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"), F.when(F.col("quality") == 1, "completed").otherwise("failed").alias("status"), F.lit("time-out").alias("error"))
    links = table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("document_id"), F.lit("20240101").alias("created"), F.col("doc_id").alias("id"), "source")
    return documents.next_batch(links, done, done).select("doc_id", "source")


@query("""SELECT doc_id, substr(replace(trim(regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t\\f\\v]+(\\n|$)', '\\1', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), chr(10), ' '), 1, 300) AS preview FROM documents""")
def text_normalise_preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("""SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[0-9][0-9.,''/:+-]*', '#', 'g')) AS masked FROM documents""")
def mask_values(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.masked(F.coalesce("text", F.lit("")), r"[0-9][0-9.,'/:+-]*"), 256).alias("masked"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
  SELECT lower(trim(line)) AS key, count(*) AS n, min(doc_id) AS first FROM l WHERE trim(line) <> '' AND length(trim(line)) <= 120 AND NOT regexp_matches(line, '[0-9=]') GROUP BY 1 HAVING count(*) > 1""")
def line_frequency_mode(spark, sf):
    lines = table(spark, sf, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    plain = F.trim("line")
    kept = lines.where((plain != "") & (F.length(plain) <= 120) & ~F.col("line").rlike("[0-9=]"))
    return kept.groupBy(F.lower(plain).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


_DOCUMENT_TEXT = "trim(regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t\\f\\v]+(\\n|$)', '\\1', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query(f"""WITH RECURSIVE l AS (SELECT doc_id, string_split({_DOCUMENT_TEXT}, chr(10)) AS l FROM documents),
  s(doc_id, i, chunk, chars) AS (SELECT doc_id, 1, 1, length(l[1]) FROM l
    UNION ALL SELECT s.doc_id, i + 1, CASE WHEN chars + 1 + length(l[i + 1]) <= 2200 THEN chunk ELSE chunk + 1 END, CASE WHEN chars + 1 + length(l[i + 1]) <= 2200 THEN chars + 1 + length(l[i + 1]) ELSE length(l[i + 1]) END FROM s JOIN l ON l.doc_id = s.doc_id WHERE i < len(l)),
  c AS (SELECT s.doc_id, length(trim(string_agg(l[i], chr(10) ORDER BY i))) AS n FROM s JOIN l ON l.doc_id = s.doc_id GROUP BY s.doc_id, chunk)
  SELECT doc_id, CAST(count(*) FILTER (n > 0) AS INT) AS chunks, CAST(max(n) AS INT) AS longest FROM c GROUP BY doc_id""")
def greedy_pack(spark, sf):
    chunks = text.packed_lines(text.document_text(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", chunks.alias("c")).select("doc_id", F.size("c").alias("chunks"), F.coalesce(F.array_max(F.transform("c", lambda x: F.length(x))), F.lit(0)).alias("longest"))


@query()
def protected_values(spark, sf):
    """Numbered placeholders: held against a round trip in tests."""
    rows = documents.protected(table(spark, sf, "documents").where("text is not null").select("doc_id", "text"))
    back = documents.restored(rows, "protected")
    return back.select("doc_id", F.size("values").alias("values"), F.sha2("protected", 256).alias("protected"), (F.col("restored") == F.col("text")).alias("round_trip"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS v FROM embeddings) SELECT vec_id, round(sum(abs(CAST(v AS DOUBLE)) * v) / sum(abs(CAST(v AS DOUBLE))), 5) AS mean, round(CAST(min(v) AS DOUBLE), 5) AS low, round(CAST(max(v) AS DOUBLE), 5) AS high FROM e GROUP BY vec_id""")
def weighted_array_mean(spark, sf):
    e = F.transform("embedding", lambda v: v.cast("double"))
    total = lambda f: F.aggregate(e, F.lit(0.0), lambda s, v: s + f(v))
    mean = F.try_divide(total(lambda v: F.abs(v) * v), total(F.abs))
    return table(spark, sf, "embeddings").select("vec_id", r(mean, 5).alias("mean"), r(F.array_min(e), 5).alias("low"), r(F.array_max(e), 5).alias("high"))


@query("""WITH p AS (SELECT doc_id, CAST(coalesce(length(text), 0) // 300 AS INT) AS pages FROM documents), s AS (SELECT doc_id, pages, unnest(range(1, pages + 1, 15)) AS first FROM p)
  SELECT doc_id, CAST(first AS INT) AS first, CAST(least(first + 14, pages) AS INT) AS last FROM s""")
def page_chunks(spark, sf):
    pages = F.floor(F.coalesce(F.length("text"), F.lit(0)) / 300).cast("int")
    chunks = table(spark, sf, "documents").select("doc_id", F.explode(ocr.page_chunks(pages)).alias("c"))
    return chunks.select("doc_id", F.element_at("c", 1).alias("first"), F.element_at("c", -1).alias("last"))


# --- streams as batches, whole proposals --------------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf):
    return ledgers.windowed_counts(table(spark, sf, "events"), "ts", "event_type", "value", "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
  s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def event_sessions(spark, sf):
    return ledgers.sessions(table(spark, sf, "events"), "ts", "user_id", "12 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def _taken(name: str, bucket: str, need: int, before: list[str]) -> str:
    used = " UNION ALL ".join(f"SELECT t FROM {x}" for x in before) or "SELECT NULL WHERE false"
    return f"{name} AS (SELECT * FROM f WHERE bucket = '{bucket}' AND t NOT IN ({used}) ORDER BY place LIMIT {need})"


_TAKEN = ", ".join(_taken(f"b{i}", bucket, need, [f"b{j}" for j in range(i)]) for i, (bucket, need) in enumerate((("treasuries", 4), ("bonds_aaa_a", 4), ("bonds_bbb", 8), ("bonds_bb", 4))))
_BUCKET_PROFILE = "median(y) AS m, mad(y) AS d, quantile_cont(y, 0.75) AS q75, quantile_cont(y, 0.9) AS q90, count(*) AS n"


@query(f"""WITH r AS (SELECT 'T' || (p_partkey % 97) AS t, 'S' || p_partkey AS s, p_size / 4.0 AS raw, (['bonds_aaa_a', 'bonds_bbb', 'bonds_bb', 'treasuries', ''])[1 + p_partkey % 5] AS bucket FROM part),
  c AS (SELECT t, s, bucket, CAST(CASE WHEN raw <= 1 THEN raw * 100 ELSE raw END AS DOUBLE) AS y FROM r WHERE CASE WHEN raw <= 1 THEN raw * 100 ELSE raw END BETWEEN 0.0001 AND 25),
  p AS (SELECT bucket, {_BUCKET_PROFILE} FROM c GROUP BY bucket), b AS (SELECT bucket, n, greatest(0, m - 2.5 * greatest(d, 0.35)) AS lower, least(q90, m + 2.5 * greatest(d, 0.35)) AS upper FROM p),
  x AS (SELECT c.*, n, y BETWEEN lower AND upper AS inside, count(*) FILTER (y BETWEEN lower AND upper) OVER (PARTITION BY c.bucket) AS k FROM c JOIN b ON b.bucket = c.bucket), kept AS (SELECT t, s, bucket, y FROM x WHERE inside OR k < greatest(3, least(5, n))),
  p2 AS (SELECT bucket, {_BUCKET_PROFILE} FROM kept GROUP BY bucket), t2 AS (SELECT bucket, least(q75, m + 1.25 * greatest(d, 0.35)) AS target, greatest(least(q90, m + 2.5 * greatest(d, 0.35)) - greatest(0, m - 2.5 * greatest(d, 0.35)), 1) AS spread FROM p2),
  z AS (SELECT kept.*, greatest(0, 1 - abs(y - target) / spread) AS score, abs(y - target) AS distance FROM kept JOIN t2 ON t2.bucket = kept.bucket),
  o AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY bucket, t ORDER BY score DESC, distance, y DESC, t, s) = 1), f AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, distance, y DESC, t, s) AS place FROM o), {_TAKEN}
  SELECT bucket, t AS "Ticker", s AS "Symbol_x", y AS current_yield, CAST(1 AS INT) AS round FROM (SELECT * FROM b0 UNION ALL SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3)""")
def portfolio_proposal(spark, sf):
    """Every bucket finds what it needs here; left-over rounds are held against a plain loop in tests."""
    k = F.col("p_partkey") % 5
    rating = F.when(k == 0, "AA+").when(k == 1, "BBB").when(k == 2, "BB-").when(k == 3, "UST").otherwise("B")
    part = table(spark, sf, "part").select(F.concat(F.lit("T"), F.col("p_partkey") % 97).alias("Ticker"), F.concat(F.lit("S"), "p_partkey").alias("Symbol"), (F.col("p_size") / 4).alias("Current Yield"), rating.alias("S&P Equivalent"))
    weights = {"treasuries": 0.2, "bonds_aaa_a": 0.2, "bonds_bbb": 0.4, "bonds_bb": 0.2}
    return portfolio.proposal(portfolio.universe(part), weights).select("bucket", "Ticker", "Symbol_x", F.col("`Current Yield_x`").alias("current_yield"), "round")



#: Second names of queries.
for _name in ("ocr_text_score", "line_frequency", "normalised_name_match"):
    _first = "line_frequency_mode" if _name == "line_frequency" else _name
    QUERIES[f"{_name}_all"], SQL[f"{_name}_all"] = QUERIES[_first], SQL[_first]
