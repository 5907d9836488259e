"""Registered queries of single rules, over cells spelled in the ways that a rule knows, with the rule restated in SQL.

choice() and choice_sql() give a row one of some values by a number of its own, in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.fixed_values import ADVERSE_WORDS, COMPLEX_PRODUCTS, DERIVATIVE_PRODUCTS, FATF_CODES, FATF_NAMES, GLOSSARY_LINE, LEAK_MARKERS, MOODYS_SCALE, RISKY_PRODUCT_WORDS, SIMPLE_PRODUCTS, SP_SCALE, SP_TEXT_ORDER, TREASURY_PATTERNS
from larkspur.functions import bonds, dates, numbers, ocr, ratings, risk, text
from larkspur.operators import selection
from larkspur.plans import documents
from larkspur.plans.catalogue import AS_OF, query, r, table
from larkspur.sources import reports as files


def choice(number: Column, values: list, kind: str = "string") -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (1 + number % len(values)).cast("int"))


def sql_text(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def choice_sql(number: str, values: list) -> str:
    return f"([{', '.join(map(sql_text, values))}])[1 + ({number}) % {len(values)}]"


def sql_list(values) -> str:
    return "[" + ", ".join(map(sql_text, values)) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join(map(sql_text, values)) + ")"


# --- numbers and prices ------------------------------------------------------------------------------------------------

_NUMBERS = ["1,234.5 USD", "-3.25", "12.5%", "n/a", "", " 0 ", "C98.7", "0.4", None, " None ", "NaT"]


@query(f"""WITH t AS (SELECT p_partkey, {choice_sql("p_partkey", _NUMBERS)} AS t FROM part),
  n AS (SELECT *, TRY_CAST(replace(trim(t), '%', '') AS DOUBLE) AS n FROM t)
  SELECT p_partkey, nullif(TRY_CAST(nullif(regexp_extract(t, '[0-9.]+'), '') AS DOUBLE), 0) AS leading,
    coalesce(TRY_CAST(nullif(regexp_extract(replace(t, ',', ''), '[-+]?[0-9]*\\.?[0-9]+'), '') AS DOUBLE), 0) AS signed, n AS number,
    coalesce(round_even(CASE WHEN n BETWEEN 0 AND 1 THEN n * 100 ELSE n END, 4), 0) AS percent,
    CASE WHEN trim(t) <> '' AND lower(trim(t)) NOT IN ('nan', 'nat', 'none', 'null') THEN trim(t) END AS usable, coalesce(trim(t), '') = '' AS blank FROM n""")
def number_texts(spark, sf):
    t = choice(F.col("p_partkey"), _NUMBERS)
    return table(spark, sf, "part").select(
        "p_partkey", bonds.leading_number(t).alias("leading"), bonds.signed_price(t).alias("signed"), numbers.number(t).alias("number"),
        numbers.percent(numbers.number(t)).alias("percent"), numbers.usable_text(t).alias("usable"), numbers.is_blank(t).alias("blank"),
    )


@query("SELECT l_orderkey, l_linenumber, l_quantity - l_extendedprice AS pressure FROM lineitem")
def size_pressures(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", bonds.size_pressure(F.col("l_quantity"), F.col("l_extendedprice")).alias("pressure"))


# --- ratings -----------------------------------------------------------------------------------------------------------

_EQUIVALENTS, _SPS, _TEXTS, _MOODYS = [None, "", " bbb+ ", "AA"], [None, "BB", "b b-"], ["rated BBB- stable", "NR", "(CAA1)", None], ["Baa2", "aaa", "zz", None, " ca "]
_ISSUERS = ["UST 10Y", "GM CORP", "US T-NOTE", "Trust Bank", "U.S. GOVT 3%", "custom", None, "united states treasury"]
_KEYS = {"e": ("p_partkey", 1, _EQUIVALENTS), "s": ("p_partkey", 4, _SPS), "x": ("p_partkey", 12, _TEXTS), "m": ("p_partkey", 48, _MOODYS), "i": ("p_size", 1, _ISSUERS)}
_CELLS_SQL = ", ".join(f"{choice_sql(f'{k} // {by}', values)} AS {name}" for name, (k, by, values) in _KEYS.items())


@query(f"""WITH c AS (SELECT p_partkey, {_CELLS_SQL} FROM part), t AS (SELECT *, regexp_matches(upper(coalesce(i, '')), '{"|".join(TREASURY_PATTERNS)}') AS treasury FROM c),
  r AS (SELECT p_partkey, treasury, coalesce(CASE WHEN treasury THEN 'UST' END, nullif(replace(upper(trim(e)), ' ', ''), ''), nullif(replace(upper(trim(s)), ' ', ''), ''),
    list_filter({sql_list(SP_TEXT_ORDER)}, lambda n: contains(upper(x), n))[1], ({sql_list(SP_SCALE[:-1])})[list_position({sql_list([m.upper() for m in MOODYS_SCALE[:-1]])}, upper(trim(m)))], '') AS rating FROM t)
  SELECT *, CASE WHEN b = 'UST' THEN 'treasuries' WHEN b IN ('AAA', 'AA', 'A') THEN 'bonds_aaa_a' WHEN b = 'BBB' THEN 'bonds_bbb' WHEN b = 'BB' THEN 'bonds_bb' ELSE '' END AS bucket
  FROM (SELECT *, regexp_replace(rating, '[+-]', '', 'g') AS b FROM r)""".replace("SELECT *, CASE WHEN b", "SELECT p_partkey, treasury, rating, CASE WHEN b"))
def rating_resolution(spark, sf):
    cell = {name: choice(F.floor(F.col(k) / by), values) for name, (k, by, values) in _KEYS.items()}
    treasury = ratings.is_treasury(cell["i"])
    rating = ratings.resolved_rating(treasury, cell["e"], cell["s"], cell["x"], cell["m"])
    return table(spark, sf, "part").select("p_partkey", treasury.alias("treasury"), rating.alias("rating"), ratings.rating_bucket(rating).alias("bucket"))


_RATINGS = ["Baa1*-", " BBB+ (x)", "A1/A+", "n.r.", "", None, "Caa3 neg"]


@query(f"SELECT p_partkey, regexp_replace({choice_sql('p_partkey', _RATINGS)}, '[^AaBbC123/+-]', '', 'g') AS cleaned, regexp_extract(p_name, '^\\s*(\\S+)', 1) AS issuer FROM part")
def rating_and_issuer_texts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", ratings.clean_rating(choice(F.col("p_partkey"), _RATINGS)).alias("cleaned"), ratings.issuer(F.col("p_name")).alias("issuer"))


# --- names, countries, dates -------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT c_custkey, 'Ünï-' || c_name || ' ñ/ßĳ' || chr(64257) || 'Ａ' || c_mktsegment || 'øΩ' AS t FROM customer),
  f AS (SELECT c_custkey, replace(replace(replace(replace(t, 'ß', 'ss'), 'ĳ', 'ij'), chr(64257), 'fi'), 'Ａ', 'a') AS t FROM t)
  SELECT c_custkey, regexp_replace(lower(strip_accents(t)), '[^a-z0-9]', '', 'g') AS key FROM f""")
def identity_keys(spark, sf):
    """Letters that fold to several (ß, ĳ, ligatures), full-width ones, and such that fold to none (ø, Ω)."""
    spelled = F.concat(F.lit("Ünï-"), "c_name", F.lit(" ñ/ßĳ\ufb01Ａ"), "c_mktsegment", F.lit("øΩ"))
    return table(spark, sf, "customer").select("c_custkey", text.identity_key(spelled).alias("key"))


_COUNTRIES = ["IRN", " ago ", "Côte d'Ivoire", "Viet-nam", "VIETNAM", "USA", "", None, "virgin islands (UK)", "Kenya", "Ｋｅｎｙａ", "viet\u00a0nam"]


@query(f"""WITH t AS (SELECT c_custkey, {choice_sql("c_custkey", _COUNTRIES)} AS t FROM customer)
  SELECT c_custkey, CASE WHEN upper(trim(t)) IN {sql_in(FATF_CODES)} OR upper(trim(regexp_replace(regexp_replace(lower(strip_accents(replace(replace(t, 'Ｋｅｎｙａ', 'kenya'), chr(160), ' '))), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))) IN {sql_in(FATF_NAMES)} THEN 'Listed' END AS fatf FROM t""")
def fatf_listed(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", risk.fatf_status(choice(F.col("c_custkey"), _COUNTRIES)).alias("fatf"))


@query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 5 THEN o_orderdate - INTERVAL 2 HOUR WHEN 6 THEN NULL ELSE o_orderdate END AS parsed FROM orders""")
def report_times(spark, sf):
    spelled = F.lit("soon")
    formats = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd;HHmmss", "yyyyMMdd", "MM/dd/yyyy", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"]
    for i, f in enumerate(formats):
        spelled = F.when(F.col("o_orderkey") % 7 == i, F.date_format("o_orderdate", f)).otherwise(spelled)
    return table(spark, sf, "orders").select("o_orderkey", dates.report_timestamp(spelled).alias("parsed"))


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 100 - 5 AS INT) AS b FROM orders),
  m AS (SELECT o_orderkey, unnest(range(date_trunc('month', a)::TIMESTAMP, date_trunc('month', b)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS m FROM d)
  SELECT o_orderkey, strftime(m, '%Y-%m-%d') AS month FROM m""")
def month_starts(spark, sf):
    start = F.col("o_orderdate").cast("date")
    months = dates.month_series(start, F.date_add(start, (F.col("o_orderkey") % 100 - 5).cast("int")))
    return table(spark, sf, "orders").select("o_orderkey", F.explode(months).alias("month")).withColumn("month", F.col("month").cast("string"))


@query("""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - CASE isodow(o_orderdate) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS VARCHAR) AS before FROM orders""")
def previous_business_days(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", dates.previous_business_day(F.col("o_orderdate").cast("date")).cast("string").alias("before"))


# --- risk --------------------------------------------------------------------------------------------------------------

_PRODUCTS = ["", "STK", "OPT,STK", "CFD", "STK,BOND,FUND,CASH,ETF", "CRYPTO COIN", "FUT", "XYZ", "BOND,ETF"]
_MARGINS = ["Margin", "cash", None, " margin "]


@query(f"""WITH t AS (SELECT c_custkey, c_custkey % 3 AS n, list_filter(string_split({choice_sql("c_custkey // 3", _PRODUCTS)}, ','), lambda p: p <> '') AS p, coalesce(upper(trim({choice_sql("c_custkey // 27", _MARGINS)})), '') = 'MARGIN' AS m FROM customer),
  d AS (SELECT *, list_has_any(p, {sql_list(DERIVATIVE_PRODUCTS)}) AS d FROM t)
  SELECT c_custkey, CASE WHEN n = 0 THEN 3 WHEN len(list_filter(p, lambda x: regexp_matches(x, '{RISKY_PRODUCT_WORDS}'))) > 0 THEN 9 WHEN list_has_any(p, {sql_list(COMPLEX_PRODUCTS)}) THEN 7
    WHEN len(p) >= 5 OR (m AND d) THEN 5 WHEN m OR d THEN 3 WHEN len(p) > 0 AND list_has_all({sql_list(SIMPLE_PRODUCTS)}, p) THEN 1 ELSE 3 END AS risk FROM d""")
def product_risks(spark, sf):
    key = F.col("c_custkey")
    products = F.filter(F.split(choice(F.floor(key / 3), _PRODUCTS), ","), lambda p: p != "")
    return table(spark, sf, "customer").select("c_custkey", risk.product_risk(key % 3, products, choice(F.floor(key / 27), _MARGINS)).alias("risk"))


_KINDS, _STATUS, _DETAILS = ["INDIVIDUAL", "JOINT", "ORG"], [None, "true", "false", "", "1"], ["AML fine", "FRAUD case", "minor", None]


@query(f"""WITH t AS (SELECT c_custkey, {choice_sql("c_custkey", _KINDS)} AS kind, {choice_sql("c_custkey // 3", _STATUS)} AS status, {choice_sql("c_custkey // 15", _DETAILS)} AS detail, c_custkey % 13 = 0 AS pep, c_custkey % 4 = 0 AS a, c_custkey % 7 = 0 AS b, c_custkey % 5 AS w FROM customer),
  d AS (SELECT *, pep OR (coalesce(status, '') NOT IN ('', 'false', '0') AND regexp_matches(upper(coalesce(detail, '')), '{ADVERSE_WORDS}')) AS adverse FROM t)
  SELECT c_custkey, adverse, CASE WHEN adverse THEN 9 WHEN kind = 'ORG' THEN CASE WHEN a OR b OR w >= 3 THEN 7 ELSE 5 END WHEN kind = 'JOINT' THEN 3 WHEN a OR b OR w >= 3 THEN 3 ELSE 1 END AS risk FROM d""")
def customer_risks(spark, sf):
    key = F.col("c_custkey")
    none = F.lit(None).cast("string")
    told = F.array(F.struct(choice(F.floor(key / 3), _STATUS).alias("status"), none.alias("code"), choice(F.floor(key / 15), _DETAILS).alias("detail"), none.alias("details")))
    adverse = risk.adverse_signals(key % 13 == 0, told)
    a, b, person = key % 4 == 0, key % 7 == 0, choice(key, _KINDS) != "ORG"
    score = risk.customer_risk(choice(key, _KINDS), adverse, a & ~person, b & ~person, F.lit(None).cast("boolean"), (key % 5).cast("int"), a & person, b & person)
    return table(spark, sf, "customer").select("c_custkey", adverse.alias("adverse"), score.alias("risk"))


_APPLICATIONS = [
    '{"accounts":[{"margin":"Cash","tradingPermissions":[{"product":"stk","country":"us"},{"product":" opt ","country":""}]},{"tradingPermissions":[{"product":"FUT","country":"de"}]}]}',
    '{"accounts":[{"margin":"Margin"}]}', '{"accounts":[]}', "{}", "no json", None,
]


@query(f"""SELECT c_custkey, {choice_sql("c_custkey", ["STK,OPT,FUT", "", "", "", "", ""])} AS products, {choice_sql("c_custkey", ["US,DE", "", "", "", "", ""])} AS countries, {choice_sql("c_custkey", [2, 1, 0, -1, -1, -1])} AS accounts FROM customer""")
def permitted_products(spark, sf):
    accounts = risk.application_accounts(F.try_parse_json(choice(F.col("c_custkey"), _APPLICATIONS)))
    listed = lambda what: F.array_join(risk.permitted(accounts, what), ",")
    return table(spark, sf, "customer").select("c_custkey", listed("product").alias("products"), listed("country").alias("countries"), F.coalesce(F.size(accounts), F.lit(-1)).alias("accounts"))


# --- recognised and translated text ------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT l_orderkey AS d, l_linenumber AS n, CASE WHEN l_linenumber % 4 = 3 THEN ' ' ELSE 'page ' || l_linenumber || ' ' || l_returnflag || l_linestatus END AS text, round(l_discount * 9 + 0.03, 4) AS conf,
    CASE WHEN l_linenumber % 3 = 0 THEN 'xy' ELSE 'long word' END AS region, CASE WHEN l_linenumber = 1 THEN round(0.3 + (l_orderkey % 8) / 10.0, 2)::DOUBLE END AS q FROM lineitem),
  g AS (SELECT d, trim(string_agg(text, chr(10) ORDER BY n, text), ' ' || chr(10)) AS text, count(*) AS pages, count(*) FILTER (trim(text) = '') AS empty, (sum(length(region) * conf) / sum(length(region)))::DECIMAL(18, 12)::DOUBLE AS conf, count(*) FILTER (conf < 0.5) AS low, min(q) AS q FROM p GROUP BY d),
  s AS (SELECT *, length(regexp_replace(text, '\\s', '', 'g')) AS n FROM g),
  z AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE greatest(0, least(100, conf * 65 + 20 + least(10, n / 4) + 5 - empty / pages * 25 - low / pages * 15)) END::DECIMAL(18, 11) AS score FROM s),
  b AS (SELECT *, CASE WHEN score >= 80 THEN 'high' WHEN score >= 50 THEN 'review' ELSE 'low' END AS status FROM z)
  SELECT d AS document_id, pages AS page_count, empty AS empty_pages, round(conf::DECIMAL(18, 12), 6)::DOUBLE AS confidence, round(score, 7)::DOUBLE AS score, CASE WHEN q < 0.4 THEN 'low' WHEN q < 0.65 AND status = 'high' THEN 'review' ELSE status END AS status FROM b""")
def document_rollup(spark, sf):
    """Without defects; document_defects has them."""
    n = F.col("l_linenumber")
    words = F.concat_ws(" ", F.lit("page"), n, F.concat("l_returnflag", "l_linestatus"))
    region = F.struct(F.when(n % 3 == 0, "xy").otherwise("long word").alias("text"), F.round(F.col("l_discount") * 9 + 0.03, 4).alias("confidence"))
    pages = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), n.alias("page_number"), F.when(n % 4 == 3, " ").otherwise(words).alias("text"), F.array(region).alias("regions"),
        F.when(n == 1, F.round(0.3 + F.col("l_orderkey") % 8 / 10, 2)).alias("image_quality"), F.lit(None).cast("array<struct<type:string,confidence:double>>").alias("defects"),
    )
    return documents.document_quality(pages).select("document_id", "page_count", "empty_pages", r(F.col("confidence")).alias("confidence"), F.round("quality.score", 7).alias("score"), "status")


@query("""SELECT p_partkey, CAST(p_size BETWEEN 10 AND 30 AS INT) + CAST(60 - p_size BETWEEN 10 AND 30 AS INT) AS inside, CASE WHEN p_size BETWEEN 10 AND 30 THEN 'first' WHEN 60 - p_size BETWEEN 10 AND 30 THEN 'second' END AS leading FROM part""")
def words_inside(spark, sf):
    size = F.col("p_size").cast("double")
    word = lambda name, x: F.struct(F.lit(name).alias("text"), F.array(F.array(x - 1, F.lit(9.0)), F.array(x + 1, F.lit(11.0)), F.array(x, F.lit(10.5))).alias("polygon"))
    box = F.struct(F.lit(10.0).alias("left"), F.lit(0.0).alias("top"), F.lit(30.0).alias("right"), F.lit(20.0).alias("bottom"))
    found = ocr.inside(F.array(word("first", size), word("second", 60 - size)), box)
    return table(spark, sf, "part").select("p_partkey", F.size(found).alias("inside"), F.get(found, F.lit(0))["text"].alias("leading"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, greatest(1, length(t)) AS w, CASE WHEN length(t) % 7 <> 3 THEN (length(t) % 100) / 100.0 END AS c FROM l)
  SELECT doc_id, round(sum(w * c::DOUBLE) / sum(w) FILTER (c IS NOT NULL), 6) AS confidence FROM c GROUP BY doc_id""")
def weighted_confidences(spark, sf):
    parts = F.transform(F.split("text", "\n"), lambda t: F.struct(t.alias("text"), F.when(F.length(t) % 7 != 3, F.length(t) % 100 / 100).alias("confidence")))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", r(ocr.weighted_confidence(parts)).alias("confidence"))


_SPOKEN = ["Spanish; English", "french + German", "", None, "es,es,pt", "English"]


@query(f"SELECT c_custkey, {choice_sql('c_custkey', ['es,en', 'fr,de,en', 'es,en', 'es,en', 'es,pt,en', 'en'])} AS codes FROM customer")
def language_lists(spark, sf):
    codes = text.language_codes(choice(F.col("c_custkey"), _SPOKEN), {"spanish": "es", "english": "en", "french": "fr", "german": "de"})
    return table(spark, sf, "customer").select("c_custkey", F.array_join(codes, ",").alias("codes"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN sha256(text) END AS plain, octet_length(encode(text)) AS bytes FROM documents""")
def decoded_texts(spark, sf):
    data = F.concat(F.when(F.col("doc_id") % 2 == 0, "data:text/plain;base64,").otherwise(""), F.base64(F.encode("text", "UTF-8")))
    landed = table(spark, sf, "documents").select("doc_id", data.alias("data"), F.when(F.col("doc_id") % 3 != 0, "text/plain").otherwise("application/pdf").alias("mime_type"))
    return documents.decoded(landed).select("doc_id", F.sha2("plain", 256).alias("plain"), F.octet_length("content").cast("long").alias("bytes"))


_ADDED = ["", " a \x07 bell", " left PRESERVETOKEN1", " see --- GLOSSARY START ---", " number ZZX900018XZZ here", None, " SPANISH SOURCE: __PRESERVE_2", " fine words"]
_MARKED_SQL = " ".join(f"WHEN contains(t, '{m}') THEN 'Translation output copied context marker: {m}'" for m in LEAK_MARKERS)


@query(f"""WITH d AS (SELECT doc_id, coalesce(text || {choice_sql("doc_id", _ADDED)}, '') AS t FROM documents)
  SELECT doc_id, CASE WHEN NOT regexp_matches(t, '[^ \\t\\n\\x0B\\f\\r]') THEN 'Translation output is empty.' WHEN regexp_matches(t, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]') THEN 'Translation output contains terminal control characters.'
    WHEN regexp_matches(t, 'PRESERVETOKEN|ENDTOKEN|__PRESERVE_|ZZX9[0-9]{{4,}}8XZZ') THEN 'Translation output contains an unresolved protected-value token.' {_MARKED_SQL} END AS fault FROM d""")
def translation_faults(spark, sf):
    """Documents stand for translations; something is added to most of them."""
    translated = F.concat("text", choice(F.col("doc_id"), _ADDED))
    return table(spark, sf, "documents").select("doc_id", text.translation_error(translated).alias("fault"))


_LINES = {"hello world": False, "": True, "12345": True, "Page 1 of 3": True, "ACME S.A.": True, "3 de enero 2024": True, "ABC-123-X": True, "Dear Sr. Juan Pérez": False, "Sr. Juan Pérez": True, "-- 3,4 %": True}


@query(f"SELECT p_partkey, {choice_sql('p_partkey', list(_LINES.values()))} AS passes FROM part")
def passthrough_lines(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.passes_through(choice(F.col("p_partkey"), list(_LINES))).alias("passes"))


_UNIT_LINES = ["alpha text", "12", "known line"]


@query(f"""WITH l AS (SELECT p_partkey, [{", ".join(choice_sql(f"p_partkey // {3**i}", _UNIT_LINES) for i in range(4))}] AS l FROM part),
  c AS (SELECT p_partkey, len(list_filter(l, lambda x: x <> 'alpha text')) AS own, len(list_filter(l, lambda x, i: x = 'alpha text' AND (i = 1 OR l[i - 1] <> 'alpha text'))) AS runs FROM l)
  SELECT p_partkey, own + runs AS units, runs AS to_translate FROM c""")
def translation_unit_counts(spark, sf):
    lines = F.concat_ws("\n", *[choice(F.floor(F.col("p_partkey") / 3**i), _UNIT_LINES) for i in range(4)])
    glossary = spark.createDataFrame([("known line", "línea conocida")], "key string, target string")
    units = documents.translation_units(table(spark, sf, "part").select(F.col("p_partkey").alias("document_id"), lines.alias("text")), glossary)
    return units.groupBy(F.col("document_id").alias("p_partkey")).agg(F.count(F.lit(1)).alias("units"), F.count_if("translate").alias("to_translate"))


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, s, CASE doc_id % 3 WHEN 0 THEN s WHEN 1 THEN s || ' 1' ELSE s || ' =' END AS t FROM l)
  SELECT doc_id, count(*) AS lines, count(*) FILTER (s <> '' AND length(s) <= {GLOSSARY_LINE} AND NOT contains(s, '=') AND length(t) <= {GLOSSARY_LINE} AND NOT contains(t, '=') AND lower(s) <> lower(t) AND NOT regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-zÀ-ÿ]')) AS usable FROM p GROUP BY doc_id""")
def glossary_pairs(spark, sf):
    """Every line of every document with a translation that is the same, a little longer, or one with a sign that a glossary cannot hold."""
    lines = table(spark, sf, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("s"))
    target = F.when(F.col("doc_id") % 3 == 0, F.col("s")).when(F.col("doc_id") % 3 == 1, F.concat("s", F.lit(" 1"))).otherwise(F.concat("s", F.lit(" =")))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(text.glossary_pair(F.col("s"), target)).alias("usable"))


@query("""WITH p AS (SELECT p_partkey AS d, p_name || ' ' || p_type AS line, CASE WHEN p_size % 3 = 0 THEN 'b ' ELSE 'a ' END || p_type || ' ' || p_name AS target FROM part),
  c AS (SELECT lower(line) AS key, target, count(*) AS n, min(d) AS d FROM p GROUP BY ALL),
  b AS (SELECT key, sum(n) AS total, arg_max(target, {'n': n, 't': target}) AS target, min(d) AS d FROM c GROUP BY key),
  e AS (SELECT line || ' = ' || b.target AS entry, total, key, row_number() OVER (ORDER BY total DESC, key) AS k FROM b JOIN p ON p.d = b.d)
  SELECT string_agg(entry, chr(10) ORDER BY k) AS glossary, CAST(count(*) AS INT) AS entries FROM e WHERE k <= 100""")
def glossary_of_pairs(spark, sf):
    """Names are short enough for the budget of characters to hold the hundred entries it may have."""
    target = F.concat_ws(" ", F.when(F.col("p_size") % 3 == 0, "b").otherwise("a"), "p_type", "p_name")
    pairs = table(spark, sf, "part").select(F.col("p_partkey").alias("document_id"), F.concat_ws(" ", "p_name", "p_type").alias("source"), target.alias("translated"))
    return documents.translation_memory(pairs)


@query("""SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS pages FROM documents""")
def form_feed_pages(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.page_count(F.replace(F.col("text"), F.lit("\n"), F.lit("\f"))).cast("long").alias("pages"))


@query("""WITH t AS (SELECT doc_id, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS p FROM documents),
  n AS (SELECT doc_id, length(p) AS chars, length(regexp_replace(p, '[\\x09-\\x0D\\x{85}]|\\pZ', '', 'g')) AS n, length(regexp_replace(p, '[\\x09-\\x0D]|\\pC|\\pZ', '', 'g')) AS fine, length(regexp_replace(p, '[\\x09-\\x0D]|\\pC|\\pZ|\\x{FFFD}', '', 'g')) AS clean FROM t)
  SELECT doc_id, round(CASE WHEN chars = 0 THEN 0 ELSE 0.6 * 65 + fine / greatest(1, n) * 20 + least(10, n / 4) + clean / greatest(1, n) * 5 - 0.5 * 25 END + least(50, chars / 10.0)::DOUBLE, 6) AS rank FROM n""")
def ocr_attempts(spark, sf):
    """Ranks of attempts with a confidence of 0.6 and one empty page of two."""
    none = F.lit(0)
    return table(spark, sf, "documents").select("doc_id", r(ocr.rank_score(ocr.assessed(F.col("text"), F.lit(0.6), F.lit(2), none, F.lit(1), none))).alias("rank"))


# --- rows as stored and shown ------------------------------------------------------------------------------------------


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS cust_id, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status, strftime(o_orderdate, '%Y%m%d%H%M%S') AS placed, o_totalprice AS total,
  '{AS_OF.replace("-", "")}000000' AS created, '{AS_OF.replace("-", "")}000000' AS updated FROM orders""")
def stored_rows(spark, sf):
    status = F.when(F.col("o_orderstatus") == "P", "None").otherwise(F.col("o_orderstatus"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust_id"), status.alias("status"), F.col("o_orderdate").alias("placed"), F.col("o_totalprice").alias("total"))
    return files.stored(rows, F.lit(AS_OF).cast("date"))


@query("""SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, to_json([CASE WHEN event_type <> 'error' THEN user_id END])::VARCHAR AS ids FROM events""")
def json_safe_rows(spark, sf):
    value = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    ids = F.array(F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("user_id").cast("double")))
    safe = selection.json_safe(table(spark, sf, "events").select("event_id", value.alias("value"), "ts", ids.alias("ids")))
    return safe.withColumn("ids", F.to_json(F.transform("ids", lambda x: x.cast("long")), {"ignoreNullFields": "false"}))


@query("SELECT doc_id, lang FROM documents WHERE source IS NOT NULL")
def known_columns_of_guarded_read(spark, sf):
    docs = selection.guarded(table(spark, sf, "documents"), {"source": "any"}, "text")
    return selection.known_columns(docs.where("source is not null"), ["doc_id", "lang", "tags"])


@query("""SELECT conv_id, turn, role FROM conversations ORDER BY coalesce(CAST(turn AS VARCHAR), ''), conv_id""")
def comments_by_creation(spark, sf):
    return selection.by_creation(table(spark, sf, "conversations").select("conv_id", "turn", "role"), "turn", "conv_id")


@query("""WITH p AS (SELECT l_orderkey AS d, l_discount * 10 AS c, CASE l_linenumber % 4 WHEN 0 THEN 'quality/defect_blurry' WHEN 1 THEN 'quality/defect_dark' WHEN 2 THEN 'quality/defect_glare' ELSE 'other' END AS kind, 0.5 + l_tax * 5 AS q FROM lineitem),
  g AS (SELECT d, count(DISTINCT kind) FILTER (kind IN ({severe}) AND c >= {low_defect}) AS severe, bool_or(kind IN ({severe}, {review}) AND c >= {review_defect}) AS seen, min(q) AS q FROM p GROUP BY d)
  SELECT d AS document_id, CASE WHEN q < {low} OR severe >= 2 THEN 'low' WHEN q < {mid} OR seen THEN 'review' ELSE 'high' END AS status FROM g""".format(
    severe=", ".join(f"'{x}'" for x in ocr.SEVERE_DEFECTS), review=", ".join(f"'{x}'" for x in ocr.REVIEW_DEFECTS), low_defect=ocr.LOW_DEFECT, review_defect=ocr.REVIEW_DEFECT, low=ocr.LOW_PROVIDER_QUALITY, mid=ocr.REVIEW_PROVIDER_QUALITY))
def document_defects(spark, sf):
    """Statuses after a provider's defects: two severe ones, one that asks for a review, or a low image quality."""
    n, kinds = F.col("l_linenumber") % 4, ("quality/defect_blurry", "quality/defect_dark", "quality/defect_glare")
    kind = F.when(n == 0, kinds[0]).when(n == 1, kinds[1]).when(n == 2, kinds[2]).otherwise("other")
    defect = F.struct(kind.alias("type"), (F.col("l_discount") * 10).alias("confidence"))
    pages = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("document_id")).agg(F.collect_list(defect).alias("defects"), F.min(0.5 + F.col("l_tax") * 5).alias("quality"))
    return pages.select("document_id", ocr.downgraded(F.lit("high"), F.col("quality"), F.col("defects")).alias("status"))


@query("""SELECT o_custkey AS document_id, sum(o_orderkey % 15 + 1) AS pages, CAST(sum(CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 15 + 1) * (o_orderkey % 100) END) AS DOUBLE) / CAST(sum(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 15 + 1 END) AS DOUBLE) AS image_quality FROM orders GROUP BY o_custkey""")
def chunk_qualities(spark, sf):
    """Orders stand for chunks of pages; some have no image quality. Whole numbers, so that sums are exact."""
    key = F.col("o_orderkey")
    chunks = table(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), (key % 15 + 1).alias("pages"), F.when(key % 4 != 0, (key % 100).cast("double")).alias("image_quality"))
    return documents.chunk_quality(chunks).select("document_id", "pages", "image_quality")


@query("""WITH p AS (SELECT p_partkey AS d, repeat(CASE WHEN p_partkey % 3 = 0 THEN 'long ' ELSE 'x ' END, CASE WHEN p_partkey % 3 = 0 THEN 14 ELSE 2 END) || p_name || ' ' || p_type AS line, 'to ' || p_type || ' ' || p_name AS target FROM part),
  k AS (SELECT * FROM p WHERE length(line) <= 120 AND length(target) <= 120), g AS (SELECT lower(line) AS key, min(d) AS d, count(*) AS n FROM k GROUP BY 1),
  e AS (SELECT line || ' = ' || target AS entry, row_number() OVER (ORDER BY n DESC, key) AS i FROM g JOIN k ON k.d = g.d)
  SELECT CASE WHEN length(entry) > 100 THEN 'long' ELSE 'short' END AS kind, count(*) AS entries, max(length(entry)) <= 243 AS fits FROM e GROUP BY 1""")
def glossary_entries(spark, sf):
    """Entries that compete for a glossary's budget, before it is spent (tests hold the skip of those that no longer fit against a loop)."""
    key = F.col("p_partkey")
    line = F.concat(F.when(key % 3 == 0, F.repeat(F.lit("long "), F.lit(14))).otherwise(F.repeat(F.lit("x "), F.lit(2))), "p_name", F.lit(" "), "p_type")
    pairs = table(spark, sf, "part").select(key.alias("document_id"), line.alias("source"), F.concat(F.lit("to "), "p_type", F.lit(" "), "p_name").alias("translated"))
    entry = F.length("entry")
    kind = F.when(entry > 100, "long").otherwise("short")
    return documents.glossary_entries(pairs).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("entries"), (F.max(entry) <= 243).alias("fits"))
