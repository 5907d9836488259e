"""Reports: bond analytics, positions, quotes, trade tickets, unfunded accounts, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.fixed_values import FORMULA_COLUMNS, POSITION_COLUMNS, TICKET_BREAKS, TICKET_COLUMNS
from larkspur.functions import bonds, dates, ratings
from larkspur.functions.numbers import is_blank
from larkspur.operators import joins, selection


def bond_analytics(quotes: DataFrame, as_of: Column, strict: bool = True) -> DataFrame:
    """Quote rows (Symbol, Ask, Bid, Last, sizes, Coupon, Maturity, Payment Frequency, Ratings, Financial Instrument) with the derived columns of the bond report."""
    n = lambda c: F.col(f"`{c}`").try_cast("double")
    price = bonds.first_valid_price(n("Ask"), n("Bid"), n("Last"))
    frequency = bonds.payment_frequency(F.col("`Payment Frequency`"))
    parsed = ratings.agency_ratings(F.col("Ratings"))
    out = quotes.withColumns(
        {
            "CY": bonds.current_yield(n("Coupon"), n("Last"), n("Ask"), n("Bid")),
            "Price": price,
            "Frequency": frequency,
            "Price Cluster": bonds.price_cluster(price),
            "Size Preasure": bonds.size_pressure(n("Ask Size"), n("Bid Size")),
            "Duration": bonds.duration(F.col("Maturity"), n("Coupon") / 100, price, frequency, as_of),
            "Moodys": ratings.clean_rating(parsed["moodys"]),
            "SP": ratings.clean_rating(parsed["sp"]),
            "Issuer": ratings.issuer(F.col("`Financial Instrument`")),
            "Years to Maturity": bonds.years_between(as_of, F.col("Maturity")),
        }
    )
    level = ratings.worse_level(ratings.rating_level(F.col("Moodys"), strict), ratings.rating_level(F.col("SP"), strict))
    out = out.withColumn("YTM", bonds.yield_to_maturity(F.col("Price"), n("Coupon"), F.col("`Years to Maturity`"))).withColumn("Rating Level", level)
    return out.withColumn("S&P Equivalent", ratings.sp_equivalent(F.col("`Rating Level`")))


def positions_with_quotes(positions: DataFrame, quotes: DataFrame) -> DataFrame:
    """Every quote with the bond lots held of it; a quote held in two lots is two rows."""
    lots = positions.where((F.col("AssetClass") == "BOND") & (F.col("LevelOfDetail") == "LOT"))
    return joins.right_by_prefixed_key(lots, "Conid", quotes, "Symbol", "IBCID")


def average_annual_return(bars: DataFrame, years: int = 5) -> DataFrame:
    """(conid, average_return) of bars (conid, ts, close): the last of a time counts, closes above zero only; anchors lie whole years before each conid's latest bar."""
    valid = bars.where(F.col("close") > 0).groupBy("conid", "ts").agg(F.max_by("close", "n").alias("close"))
    latest = valid.groupBy("conid").agg(F.max("ts").alias("latest"))
    anchors = [(k, F.col("latest") - F.make_ym_interval(F.lit(k))) for k in range(years + 1)]
    return joins.anchor_returns(joins.as_of(valid.join(latest, "conid"), "conid", "ts", "close", anchors), "conid", "close", years + 1)


def trade_ticket(trades: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One consolidated row per group of keys: sums, mean price, accrued days, totals and kind. Groups with several descriptions or a zero accrued interest have a `fault`."""
    absolute = lambda c: F.abs(F.col(c).cast("double"))
    first = F.struct(*order)
    rows = trades.withColumns({c: absolute(c) for c in ("Quantity", "AccruedInterest", "NetCash")}).withColumn("Price", F.col("Price").cast("double"))
    carried = [c for c in trades.columns if c not in {*keys, "Quantity", "AccruedInterest", "NetCash", "Price", "Description", "Exchange"}]
    n = F.count(F.lit(1))
    grouped = rows.groupBy(*keys).agg(
        n.alias("_n"), F.sum("Quantity").alias("Quantity"), F.sum("AccruedInterest").alias("AccruedInterest"), F.sum("NetCash").alias("NetCash"), F.try_divide(F.sum("Price"), n).alias("Price"),
        F.countDistinct("Description").alias("_d"), F.bool_or(F.col("AccruedInterest") == 0).alias("_z"), F.min_by("Description", first).alias("Description"),
        F.when(n == 1, F.min_by("Exchange", first)).otherwise(F.lit("")).alias("Exchange"), *[F.min_by(c, first).alias(c) for c in carried],
    )
    details = grouped.withColumn("_b", bonds.bond_details(F.col("Description")))
    return details.select(
        *keys, *carried, "Description", "Exchange", "Quantity", "AccruedInterest", "NetCash", "Price", F.col("_b.coupon").alias("Coupon"), F.col("_b.maturity").alias("Maturity"),
        F.col("NetCash").alias("Amount"), bonds.accrued_days(F.col("AccruedInterest"), F.col("_b.coupon"), F.col("Quantity")).alias("Accrued (Days)"),
        F.bround(F.col("AccruedInterest") + F.col("NetCash"), 2).alias("TotalAmount"), F.bround(F.try_divide("NetCash", "Quantity") * 100, 4).alias("Price (including Commissions)"),
        F.when(F.col("_n") == 1, "single").otherwise("consolidated").alias("type"),
        F.when(F.col("_d") != 1, "several descriptions").when(F.col("_z"), "no accrued interest").alias("fault"),
    )


def ticket_message(tickets: DataFrame) -> Column:
    """`key: value` lines of the confirmation's columns; columns that tickets lacks are empty."""
    parts = []
    for name in TICKET_COLUMNS:
        value = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) if name in tickets.columns else F.lit("")
        parts += [F.lit(f"{name}: "), value, F.lit("\n\n" if name in TICKET_BREAKS else "\n")]
    return F.concat(*parts)


def unfunded_accounts(accounts: DataFrame, nav: DataFrame, clients: DataFrame, links: DataFrame, advisors: DataFrame, contacts: DataFrame, today: Column, excluded: list[str]) -> DataFrame:
    """(account, email, name, advisor_email, business_days, notice_number) of open accounts without value or with a zero one, e-mails excluded aside."""
    account = F.col("ibkr_account_number")
    values = nav.select(F.col("ClientAccountID").alias("_id"), F.col("Total").cast("double").alias("_total"))
    without = accounts.join(values, account == F.col("_id"), "left_anti").unionByName(accounts.join(values.where("_total = 0"), account == F.col("_id"), "left_semi"))
    opened = clients.where(F.col("Status") == "Open").groupBy(F.col("`Account ID`").alias("_c")).agg(F.min("Date Opened").alias("opened"))
    open_accounts = without.join(opened, account == F.col("_c")).drop("_c")
    days = dates.business_days_since(F.col("opened"), today)
    newest = selection.latest(links, ["account_id"], [F.coalesce("updated", "created", F.lit("")).desc(), F.col("contact_id")]).select("account_id", "contact_id")
    people = contacts.select(F.col("id").alias("_p"), F.col("email"), F.col("name"))
    of_advisor = advisors.join(contacts.select(F.col("id").alias("contact_id"), F.col("email").alias("advisor_email")), "contact_id", "left").select(F.col("code").alias("advisor_code"), "advisor_email")
    out = open_accounts.join(newest, open_accounts["id"] == newest["account_id"], "left").join(joins.small(of_advisor), "advisor_code", "left").join(people, F.col("contact_id") == F.col("_p"), "left")
    kept = out.where(~F.lower(F.trim(F.coalesce("email", F.lit("")))).isin(*[e.strip().lower() for e in excluded])) if excluded else out
    return kept.select(account.alias("account"), "email", "name", "advisor_email", days.alias("business_days"), dates.notice_number(days).alias("notice_number"))


def alias_proposals(clients: DataFrame, closed: tuple[str, ...] = ("Closed", "Rejected")) -> DataFrame:
    """(account, alias): account id and title (the master account's where there is one) of accounts without an alias; rows without a title are left out."""
    wanted = clients.where(is_blank(F.col("Alias")) & ~F.coalesce("Status", F.lit("")).isin(*closed))
    masters = clients.groupBy(F.col("`Account ID`").alias("_m")).agg(F.max("Title").alias("_title"))
    titled = wanted.join(masters, F.col("`Master Account`") == F.col("_m"), "left")
    title = F.trim(F.coalesce(F.nullif(F.trim("_title"), F.lit("")), F.col("Title"), F.lit("")))
    return titled.where(title != "").select(F.col("`Account ID`").alias("account"), F.concat_ws(" ", F.col("`Account ID`"), title).alias("alias"))


def commissions(rows: DataFrame, start=None, end=None) -> DataFrame:
    """Trades or deposits by year, month and date, newest first; bounds included."""
    day = F.coalesce(*[dates.report_timestamp(F.col(f"`{c}`").cast("string")) for c in ("TradeDate", "Date/Time", "Date") if c in rows.columns])
    dated = selection.within_days(rows.withColumn("_day", day), F.col("_day"), start, end)
    return dated.orderBy(F.desc("Year"), F.desc("Month"), F.desc("_day")).drop("_day")


def ending_balances(rows: DataFrame) -> DataFrame:
    """Statement rows with the running balance of each account by date and line."""
    frame = Window.partitionBy("Account").orderBy("Date", "line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("balance", F.sum("Amount").over(frame))


def open_positions(positions: DataFrame) -> DataFrame:
    """The open-positions template: the report's columns in order, null as empty text, and after them the blank columns for formulas. A column that is missing raises."""
    lost = [c for c in POSITION_COLUMNS if c not in positions.columns]
    if lost:
        raise ValueError(f"missing columns {lost}")
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in POSITION_COLUMNS]
    return positions.select(*cells, *[F.lit("").alias(c) for c in FORMULA_COLUMNS])
