"""Portfolio construction: archetypes, distributions, candidate ranking, bucket filling, proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.fixed_values import ARCHETYPES, BUCKETS, TOP_SCORE, TOTAL_ASSETS
from larkspur.functions import numbers, ratings
from larkspur.operators import joins, profiles
from larkspur.shared import kept

WEIGHTED = ("treasuries", "bonds_aaa_a", "bonds_bbb", "bonds_bb", "etfs")
#: Columns that may hold an equity's yield, a symbol, an asset's metadata, in order of trust.
YIELD_COLUMNS = ["Current Yield", "current_yield", "Dividend Yield", "dividend_yield", "Yield(UserInput)", "Average Annual Return", "average_annual_return", "Yield", "yield", "YTM", "ytm"]
SYMBOL_COLUMNS = ["Symbol", "symbol", "Ticker", "ticker", "sheet_name"]
MATCH_COLUMNS = [*SYMBOL_COLUMNS, "Financial Instrument", "financialInstrument"]
METADATA = {"industry": ["industry", "Industry", "sector", "Sector"], "coupon": ["coupon", "Coupon"], "years_to_maturity": ["years_to_maturity", "Years to Maturity", "yearsToMaturity"], "duration": ["duration", "Duration"], "maturity": ["maturity", "Maturity"]}
MOST_YIELD = 25.0


def archetypes(spark: SparkSession) -> DataFrame:
    """The risk archetypes, eight rows."""
    return spark.createDataFrame(ARCHETYPES, "id int, archetype string, treasuries double, bonds_aaa_a double, bonds_bbb double, bonds_bb double, etfs double, min_score double, max_score double")


def with_archetype(df: DataFrame, score: Column) -> DataFrame:
    """Adds the archetype whose range holds the score; null outside all."""
    return joins.in_range(df, score.try_cast("double"), archetypes(df.sparkSession), "min_score", "max_score", TOP_SCORE)


def archetype_distribution(df: DataFrame) -> DataFrame:
    """(…, bucket, weight) of rows with archetype columns, normalised to 1."""
    total = sum((F.col(c) for c in WEIGHTED[1:]), F.col(WEIGHTED[0]))
    share = lambda c: F.when((total > 0) & (F.abs(total - 1) > 1e-5 + 1e-8), F.try_divide(F.col(c), total)).otherwise(F.col(c))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("bucket"), share(c).alias("weight")) for c in WEIGHTED]))
    return df.select(*[c for c in df.columns if c not in (*WEIGHTED, "min_score", "max_score")], cells.alias("_d")).select("*", "_d.*").drop("_d")


def plan_distribution(allocation: dict[str, float], rating_allocation: dict[str, float], archetype: str | None = None) -> dict[str, float]:
    """Weights of a portfolio plan in percent; those of its archetype where the plan is the archetype's default."""
    chosen = next((dict(zip(("treasuries", "bonds_aaa_a", "bonds_bbb", "bonds_bb", "etfs"), a[2:7], strict=True)) for a in ARCHETYPES if a[1] == (archetype or "").strip()), None)
    if chosen and _as_numbers(allocation) == default_allocation(chosen) and _as_numbers(rating_allocation, ("aaa", "bbb", "bb")) == default_ratings(chosen):
        return normalized(chosen)
    of = lambda d, k: float(d.get(k) or 0) / 100
    bonds = of(allocation, "bonds")
    return normalized({"treasuries": of(allocation, "cash") + of(allocation, "treasuries"), "bonds_aaa_a": bonds * of(rating_allocation, "aaa"), "bonds_bbb": bonds * of(rating_allocation, "bbb"), "bonds_bb": bonds * of(rating_allocation, "bb"), "etfs": of(allocation, "stocks")})


def _as_numbers(plan: dict, keys: tuple[str, ...] = ("cash", "treasuries", "bonds", "stocks")) -> dict[str, float]:
    return {k: float(plan.get(k) or 0) for k in keys}


def _up(x: float) -> float:
    return float(int((x + 0.5) // 1))


def default_allocation(weights: dict[str, float]) -> dict[str, float]:
    bonds = weights["bonds_aaa_a"] + weights["bonds_bbb"] + weights["bonds_bb"]
    return {"cash": 0.0, "treasuries": _up(weights["treasuries"] * 100), "bonds": _up(bonds * 100), "stocks": _up(weights["etfs"] * 100)}


def default_ratings(weights: dict[str, float]) -> dict[str, float]:
    bonds = weights["bonds_aaa_a"] + weights["bonds_bbb"] + weights["bonds_bb"]
    if bonds <= 0:
        return {"aaa": 0.0, "bbb": 50.0, "bb": 50.0}
    aaa, bbb = _up(weights["bonds_aaa_a"] / bonds * 100), _up(weights["bonds_bbb"] / bonds * 100)
    return {"aaa": aaa, "bbb": bbb, "bb": max(0.0, 100 - aaa - bbb)}


def plan_columns(weights: dict[str, Column]) -> dict[str, Column]:
    """The default plan of an archetype's weights, in whole percent: cash, treasuries, bonds, stocks, and of the bonds aaa, bbb, bb. Halves go up."""
    up = lambda x: F.floor(x * 100 + 0.5).cast("double")
    bonds = weights["bonds_aaa_a"] + weights["bonds_bbb"] + weights["bonds_bb"]
    share = lambda w, none: F.when(bonds <= 0, F.lit(none)).otherwise(up(F.try_divide(w, bonds)))
    aaa, bbb = share(weights["bonds_aaa_a"], 0.0), share(weights["bonds_bbb"], 50.0)
    bb = F.when(bonds <= 0, F.lit(50.0)).otherwise(F.greatest(F.lit(0.0), 100 - aaa - bbb))
    return {"cash": F.lit(0.0), "treasuries": up(weights["treasuries"]), "bonds": up(bonds), "stocks": up(weights["etfs"]), "aaa": aaa, "bbb": bbb, "bb": bb}


PLAN = ("cash", "treasuries", "bonds", "stocks", "aaa", "bbb", "bb")


def plan_weights(plans: DataFrame) -> DataFrame:
    """Saved plans (plan struct of PLAN in percent, archetype) with their `weights` (a struct by bucket, making 1): those of the archetype itself where the plan is its default, else the plan's own. Any number of plans, no loop on the driver."""
    known = archetypes(plans.sparkSession).select(F.trim("archetype").alias("_archetype"), F.struct(*WEIGHTED).alias("_w"))
    rows = plans.join(F.broadcast(known), F.trim("archetype") == F.col("_archetype"), "left")  # eight rows
    has = lambda k: F.coalesce(F.col("plan")[k].cast("double"), F.lit(0.0))
    default = plan_columns({b: F.col("_w")[b] for b in WEIGHTED})
    same = F.lit(True)
    for k in PLAN:
        same = same & (has(k) == default[k])
    part = lambda k: has(k) / 100
    own = {"treasuries": part("cash") + part("treasuries"), "bonds_aaa_a": part("bonds") * part("aaa"), "bonds_bbb": part("bonds") * part("bbb"), "bonds_bb": part("bonds") * part("bb"), "etfs": part("stocks")}
    chosen = F.struct(*[F.when(F.coalesce(same, F.lit(False)), F.col("_w")[b]).otherwise(own[b]).alias(b) for b in WEIGHTED])
    placed = rows.withColumn("_chosen", chosen)
    total = sum((F.col("_chosen")[b] for b in WEIGHTED[1:]), F.col("_chosen")[WEIGHTED[0]])
    scaled = lambda b: F.when((total > 0) & (F.abs(total - 1) > 1e-5 + 1e-8), F.try_divide(F.col("_chosen")[b], total)).otherwise(F.col("_chosen")[b])
    return placed.withColumn("weights", F.struct(*[scaled(b).alias(b) for b in WEIGHTED])).drop("_archetype", "_w", "_chosen")


def proposals(candidates: DataFrame, profiles_: DataFrame, key: str) -> DataFrame:
    """(key, bucket, n, Symbol_x, Ticker, Current Yield_x): the ranked assets for each of many profiles (key, weights as plan_weights gives them), by the same filling as proposal(), without its left-over round.

    Candidates are ranked once, and buckets filled once for each number of assets a bucket that some profile asks for. A profile takes as many of a bucket as its weights ask for, in the order of buckets, and no ticker
    twice: over the best 2 * TOTAL_ASSETS of each bucket, which is as far as any profile can reach, held as one row beside each.
    """
    best = ranked(candidates).where(F.col("place") <= 2 * TOTAL_ASSETS)
    entry = F.struct(F.lit(0).alias("b"), F.col("place"), "bucket", "Ticker", "Symbol_x", F.col("`Current Yield_x`").alias("y"))
    order = ratings.literal_map([(b, i) for i, b in enumerate(BUCKETS)])
    listed = best.where(F.col("bucket").isin(*BUCKETS)).agg(F.sort_array(F.collect_list(entry.withField("b", F.try_element_at(order, F.col("bucket"))))).alias("_all"))
    need = F.array(*[numbers.half_even(TOTAL_ASSETS * F.col("weights")[b]).cast("int") if b in WEIGHTED else F.lit(0) for b in BUCKETS])
    start = F.struct(F.array().cast("array<struct<b:int,place:int,bucket:string,Ticker:string,Symbol_x:string,y:double>>").alias("taken"), F.array().cast("array<string>").alias("used"))
    asked = profiles_.select(key, need.alias("_need"))
    beside = asked.select("_need").distinct().crossJoin(F.broadcast(listed))  # one row of some hundred candidates

    def take(state: Column, c: Column) -> Column:
        have = F.size(F.filter(state["taken"], lambda t: t["b"] == c["b"]))
        fits = (have < F.get("_need", c["b"])) & ~F.array_contains(state["used"], c["Ticker"])
        return F.when(fits, F.struct(F.array_append(state["taken"], c).alias("taken"), F.array_append(state["used"], c["Ticker"]).alias("used"))).otherwise(state)

    each = kept(beside.select("_need", F.aggregate("_all", start, take, lambda s: s["taken"]).alias("_taken")), "filled")
    filled = asked.join(joins.small(each), "_need").select(key, F.explode("_taken").alias("t"))
    return filled.select(key, "t.bucket", F.col("t.place").alias("place"), "t.Ticker", "t.Symbol_x", F.col("t.y").alias("Current Yield_x"))


def normalized(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()} if total > 0 and abs(total - 1) > 1e-5 + 1e-8 else dict(weights)


def needs(weights: dict[str, float], total: int = TOTAL_ASSETS) -> dict[str, int]:
    """Assets wanted of each bucket; halves to the even number."""
    return {b: round(total * float(weights.get(b) or 0)) for b in BUCKETS}


def universe(bonds: DataFrame, treasuries: DataFrame | None = None) -> DataFrame:
    """Candidates of bonds and treasuries: Ticker, Symbol_x, Current Yield_x (percent), S&P Equivalent_x, bucket and metadata."""
    rows = bonds if treasuries is None else bonds.unionByName(treasuries, allowMissingColumns=True)
    have = rows.columns
    cell = lambda name: F.col(f"`{name}`") if name in have else F.lit(None).cast("string")
    symbol = numbers.first_present(have, ["Symbol", "Financial Instrument"], numbers.usable_text)
    treasury = ratings.is_treasury(*[cell(c) for c in ("Issuer", "Company Name", "Ticker", "Symbol", "Financial Instrument", "Sector", "Industry")])
    rating = ratings.resolved_rating(treasury, cell("S&P Equivalent"), cell("SP"), cell("Ratings"), cell("Moodys"))
    current = numbers.percent(numbers.first_present(have, ["Current Yield", "CY", "YTM"], numbers.number))
    ticker = numbers.first_present(have, ["Ticker", "Issuer", "Financial Instrument", "Symbol"], numbers.usable_text)
    metadata = [numbers.first_present(have, names, numbers.number if key in ("coupon", "years_to_maturity", "duration") else numbers.usable_text).alias(key) for key, names in METADATA.items()]
    rated = rows.withColumn("_rating", rating)  # a column of its own: what its bucket is made from is found once
    return rated.select(F.coalesce(ticker, F.lit("")).alias("Ticker"), symbol.alias("Symbol_x"), current.alias("Current Yield_x"), F.col("_rating").alias("S&P Equivalent_x"), ratings.rating_bucket(F.col("_rating")).alias("bucket"), *metadata)


def etf_candidates(etfs: DataFrame, equities: DataFrame | None = None) -> DataFrame:
    """ETF rows as candidates; without a yield column, at the median positive yield of the equities."""
    name = numbers.first_present(etfs.columns, ["Financial Instrument", "Symbol"], numbers.usable_text)
    base = etfs
    if "Current Yield" in etfs.columns:
        current = numbers.percent(numbers.number(F.col("`Current Yield`")))
    elif equities is not None:
        y = numbers.percent(numbers.first_present(equities.columns, YIELD_COLUMNS, numbers.number))
        base = etfs.crossJoin(F.broadcast(equities.select(y.alias("_y")).where("_y > 0").agg(F.coalesce(F.median("_y"), F.lit(0.0)).alias("_median"))))  # one row
        current = F.col("_median")
    else:
        current = F.lit(0.0)
    blank = [F.lit(None).cast("double" if k in ("coupon", "years_to_maturity", "duration") else "string").alias(k) for k in METADATA]
    return base.select(F.coalesce(name, F.lit("")).alias("Ticker"), name.alias("Symbol_x"), current.alias("Current Yield_x"), F.lit("ETF").alias("S&P Equivalent_x"), F.lit("etfs").alias("bucket"), *blank)


def cleaned(candidates: DataFrame) -> DataFrame:
    y = F.col("`Current Yield_x`")
    return candidates.where(~numbers.is_blank(F.col("Ticker")) & (y > 0) & (y <= MOST_YIELD))


def screened(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean candidates of each bucket after the outlier screen (yield as _y), and the buckets' targets and spreads by those that are left."""
    rows = kept(cleaned(candidates).withColumnRenamed("Current Yield_x", "_y"), "candidates")  # profiles read them several times
    left = kept(profiles.screened(rows, ["bucket"], "_y"), "screened")
    return left, profiles.targets(left, ["bucket"], "_y")


def ranked(candidates: DataFrame) -> DataFrame:
    """Screened candidates scored against the profile of those that are left; the best row of each ticker, with place."""
    return placed(*screened(candidates))


def placed(rows: DataFrame, targets: DataFrame) -> DataFrame:
    best = profiles.scored(rows, ["bucket"], "_y", targets)
    order = [F.desc("score"), "distance", F.desc("_y"), "Ticker", F.col("Symbol_x").asc_nulls_last()]
    first = best.withColumn("_n", F.row_number().over(Window.partitionBy("bucket", "Ticker").orderBy(*order))).where("_n = 1").drop("_n")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).withColumnRenamed("_y", "Current Yield_x")


def proposal(candidates: DataFrame, weights: dict[str, float], held: DataFrame | None = None) -> DataFrame:
    """The assets of a proposal: bucket, Symbol_x, Current Yield_x, S&P Equivalent_x, metadata, round (1: ranked, 2: left-over).

    Buckets are filled in order; a ticker serves one bucket. Each bucket takes as many rows as it needs (20 in all), so
    tickers used are a short list on the driver. What is missing then comes from the candidates left, scored against
    their bucket's profile; unknown ratings count as bonds_bb. held: tickers to leave out.
    """
    spark = candidates.sparkSession
    wanted = needs(weights)
    pool = candidates if held is None else candidates.join(held.select("Ticker").distinct(), "Ticker", "left_anti")
    # A bucket needs TOTAL_ASSETS rows at most, and buckets before it have used as many tickers at most.
    left, targets = screened(pool)
    places = placed(left, targets).where(F.col("place") <= 2 * TOTAL_ASSETS).cache()
    used: list[str] = []
    taken = []
    for bucket in BUCKETS:
        if wanted[bucket]:
            rows = places.where((F.col("bucket") == bucket) & ~F.col("Ticker").isin(*used)).orderBy("place").limit(wanted[bucket])
            got = [r.asDict() | {"round": 1} for r in rows.collect()]  # at most what the bucket needs
            taken += got
            used += [r["Ticker"] for r in got]
    short = {b: wanted[b] - sum(r["bucket"] == b for r in taken) for b in BUCKETS}
    if any(n > 0 for n in short.values()):
        profile = targets if held is None else screened(candidates)[1]  # of all candidates, held ones too
        rest = cleaned(pool).where((F.col("bucket") != "etfs") & ~F.col("Ticker").isin(*used)).withColumn("bucket", F.when(F.col("bucket") == "", "bonds_bb").otherwise(F.col("bucket")))
        near = rest.join(F.broadcast(profile), "bucket", "left")  # a row per bucket
        y = F.col("`Current Yield_x`")
        near = near.withColumn("score", profiles.nearness(y, F.coalesce("target", y), F.coalesce("spread", F.lit(1.0)))).withColumn("distance", F.abs(y - F.coalesce("target", y)))
        order = [F.desc("score"), F.desc("`Current Yield_x`"), "Ticker", F.col("Symbol_x").asc_nulls_last()]
        best = near.withColumn("_n", F.row_number().over(Window.partitionBy("Ticker").orderBy(*order))).where("_n = 1")
        best = best.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).where(F.col("place") <= TOTAL_ASSETS)  # no bucket is short of more
        need = ratings.literal_map(short.items())
        taken += [r.asDict() | {"round": 2} for r in best.where(F.col("place") <= F.try_element_at(need, F.col("bucket"))).select(*places.columns).collect()]  # at most TOTAL_ASSETS rows
    schema = f"Ticker string, Symbol_x string, `Current Yield_x` double, `S&P Equivalent_x` string, bucket string, {', '.join(f'{k} ' + ('double' if k in ('coupon', 'years_to_maturity', 'duration') else 'string') for k in METADATA)}, score double, distance double, place int, round int"
    places.unpersist()
    names = [c.split(" ")[0] if "`" not in c else c.split("`")[1] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in taken], schema)


def summary(assets: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(bucket, n, average_yield, weight, contribution) of a proposal."""
    table = ratings.literal_map([(k, float(v)) for k, v in weights.items()] or [("", 0.0)])
    per = assets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("`Current Yield_x`").alias("average_yield"))
    weight = F.coalesce(F.try_element_at(table, F.col("bucket")), F.lit(0.0))
    return per.select("bucket", "n", "average_yield", weight.alias("weight"), (F.col("average_yield") * weight).alias("contribution"))


def explicit_assets(assets: DataFrame, feeds: list[DataFrame], row_id: str) -> DataFrame:
    """Assets named by symbol and percentage: matched row (JSON) and share; percentages above 1.5 in all are percent. An unmatched symbol raises."""
    total = F.sum("percentage").over(Window.partitionBy(F.lit(0)))  # assets of one proposal
    as_share = F.when(total > 1.5, F.col("percentage") / 100).otherwise(F.col("percentage"))
    shared = assets.withColumn("share", as_share).withColumn("share", F.try_divide("share", F.sum("share").over(Window.partitionBy(F.lit(0)))))
    matched = joins.first_match(shared, "symbol", [(f, MATCH_COLUMNS) for f in feeds], row_id)
    return matched.withColumn("match", F.when(F.col("match").isNull(), F.raise_error(F.concat(F.lit("unknown symbol "), "symbol")).cast("string")).otherwise(F.col("match")))


def enriched(assets: DataFrame, feeds: list[DataFrame], row_id: str) -> DataFrame:
    """Assets (Symbol_x, metadata) with missing metadata filled from the first feed that knows the symbol."""
    matched = joins.first_match(assets, "Symbol_x", [(f, MATCH_COLUMNS) for f in feeds], row_id)
    v = F.try_parse_json("match")
    fill = {}
    for key, names in METADATA.items():
        numeric = key in ("coupon", "years_to_maturity", "duration")
        found = [(numbers.number if numeric else numbers.usable_text)(F.try_variant_get(v, f"$['{n}']", "string")) for n in names]
        fill[key] = F.coalesce(numbers.usable_text(F.col(key)).try_cast("double") if numeric else numbers.usable_text(F.col(key)), *found)
    return matched.withColumns(fill).drop("match", "feed")


def context(bonds: DataFrame, treasuries: DataFrame) -> DataFrame:
    """The candidates that proposals start from: both feeds by name; blank equivalents resolved from the other ratings; rows with a blank yield left out; yields in percent; tickers from the issuer or the instrument's first word; nulls as 0 or empty text; highest yield first."""
    rows = bonds.unionByName(treasuries, allowMissingColumns=True)
    cell = lambda name: F.col(f"`{name}`") if name in rows.columns else F.lit(None).cast("string")
    treasury = ratings.is_treasury(*[cell(c) for c in ("Issuer", "Company Name", "Ticker", "Symbol", "Financial Instrument", "Sector", "Industry")])
    resolved = ratings.resolved_rating(treasury, cell("S&P Equivalent"), cell("SP"), cell("Ratings"), cell("Moodys"))
    rating = F.when(numbers.is_blank(cell("S&P Equivalent")), resolved).otherwise(cell("S&P Equivalent"))
    ticker = F.coalesce(numbers.usable_text(cell("Issuer")), ratings.issuer(cell("Financial Instrument")))
    known = {"Financial Instrument", "Current Yield", "S&P Equivalent", "Issuer"}
    others = [F.coalesce(F.col(f"`{n}`"), F.lit(0).cast(t) if t in ("double", "float", "int", "bigint") else F.lit("").cast(t)).alias(n) if t in ("double", "float", "int", "bigint", "string") else F.col(f"`{n}`") for n, t in rows.dtypes if n not in known]
    out = rows.where(~numbers.is_blank(cell("Current Yield"))).select(
        F.coalesce(cell("Financial Instrument").cast("string"), F.lit("")).alias("Symbol_x"), F.coalesce(ticker, F.lit("")).alias("Ticker"), F.coalesce(rating, F.lit("")).alias("S&P Equivalent_x"),
        numbers.percent(numbers.number(cell("Current Yield"))).alias("Current Yield_x"), *others,
    )
    return out.orderBy(F.desc("`Current Yield_x`"), "Symbol_x")
