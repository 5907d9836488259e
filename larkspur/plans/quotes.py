"""Quote snapshots: wire rows to named columns, identity checks, derived prices and yields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.fixed_values import QUOTE_FIELDS, QUOTE_RENAMES
from larkspur.functions import bonds
from larkspur.operators import selection
from larkspur.sources.parsers import plain_conid


def named_fields(wire: DataFrame, names: dict[int, str] = QUOTE_FIELDS) -> DataFrame:
    """Columns with numbers for names under the fields' names; unknown numbers stay."""
    return wire.withColumnsRenamed({c: names[int(c)] for c in wire.columns if c.isdigit() and int(c) in names})


def identified(snapshot: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with ticker, rejected rows with reason) of a snapshot (conidEx, SYMBOL, error) against the ids asked for (ticker, conid)."""
    fault = F.col("error") if "error" in snapshot.columns else F.lit(None).cast("string")
    joined = snapshot.withColumn("conid", plain_conid(F.col("conidEx"))).join(ids.select("conid", "ticker"), "conid", "left").withColumn("_fault", fault)
    good, bad = selection.split_valid(joined, [(F.coalesce("_fault", F.lit("")) != "", "error"), (F.col("ticker").isNull(), "unmatched conid"), (F.coalesce("SYMBOL", F.lit("")) == "", "missing identity")])
    return good.drop("_fault"), bad.drop("_fault")


def without_data(ids: DataFrame, good: DataFrame) -> DataFrame:
    """Ids asked for that no good row answers."""
    return ids.join(good.select("conid").distinct(), "conid", "left_anti")


def must_be_clean(bad: DataFrame, most: int = 10) -> None:
    """Raises with up to `most` examples if anything was rejected."""
    examples = [f"{r['ticker'] or 'unknown'}: {r['reason']}" for r in bad.select("ticker", "reason").orderBy("ticker", "reason").limit(most).collect()]
    if examples:
        raise ValueError(f"{bad.count()} quotes rejected: {', '.join(examples)}")


def equity_snapshot(good: DataFrame, as_of: Column, returns: DataFrame | None = None) -> DataFrame:
    """Identified rows as the report has them: capitalised and renamed columns, last price as a number, yield from average returns (conid, average_return) where given, and a stamp."""
    named = selection.capitalized(good).withColumnsRenamed(QUOTE_RENAMES)
    priced = named.withColumn("Last", bonds.signed_price(F.col("Last_price"))) if "Last_price" in named.columns else named
    if returns is not None:
        priced = priced.join(returns.select(F.col("conid").alias("Conid"), F.col("average_return").alias("Current Yield")), "Conid", "left")
    else:
        priced = priced.withColumn("Current Yield", F.lit(None).cast("double"))
    return priced.withColumn("Timestamp", F.date_format(as_of, "yyyyMMddHHmmss"))


def bond_snapshot(rows: DataFrame, treasury: bool = False, parity: bool = True) -> DataFrame:
    """Bond rows with the yield in percent points; corporate rows without a usable last price are left out."""
    current = bonds.treasury_yield(F.col("Coupon").try_cast("double"), F.col("Last"), parity) if treasury else bonds.percent_yield(F.col("Coupon").try_cast("double"), F.col("Last"))
    out = rows.withColumn("Current Yield", current)
    return out if treasury else out.where(bonds.leading_number(F.col("Last")).isNotNull())
