"""Robust profiles of groups, outlier screens and scores against a target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators import joins, ranks
from larkspur.shared import kept

#: Fixed values of the screen: least spread, widths, least rows kept.
LEAST_MAD, WIDTH, TARGET_WIDTH = 0.35, 2.5, 1.25


def profile(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group: n, median, mad, q75, q90, lower, upper, target, spread. Quantiles are exact, for groups of any size (see ranks.quantiles)."""
    quantiles = kept(ranks.quantiles(df, keys, value, [0.5, 0.75, 0.9]).withColumnRenamed("q", "_q"), "quantiles")  # a row a group
    medians = quantiles.select(*keys, F.col("_q")[0].alias("_m"))
    centred = df.join(joins.small(medians), keys) if keys else df.crossJoin(medians)  # one row without keys
    mads = ranks.quantiles(centred.withColumn("_d", F.abs(F.col(value) - F.col("_m"))), keys, "_d", [0.5]).select(*keys, F.col("q")[0].alias("mad"))
    both = quantiles.join(mads, keys) if keys else quantiles.crossJoin(mads)
    floor = F.greatest("mad", F.lit(LEAST_MAD))
    median, q75, q90 = (F.col("_q")[i] for i in range(3))
    lower, upper = F.greatest(F.lit(0.0), median - WIDTH * floor), F.least(q90, median + WIDTH * floor)
    return both.select(*keys, "n", median.alias("median"), "mad", q75.alias("q75"), q90.alias("q90"), lower.alias("lower"), upper.alias("upper"), F.least(q75, median + TARGET_WIDTH * floor).alias("target"), F.greatest(upper - lower, F.lit(1.0)).alias("spread"))


def screened(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows within their group's bounds, if enough of them are (3 to 5, by the group's size); else all of the group."""
    bounds = kept(profile(df, keys, value).select(*keys, "n", "lower", "upper"), "bounds")
    inside = F.col(value).between(F.col("lower"), F.col("upper"))
    beside = lambda groups: df.join(_groups(groups), keys) if keys else df.crossJoin(F.broadcast(groups))  # noqa: E731 (one row without keys)
    counted = beside(bounds).groupBy(*keys).agg(F.count_if(inside).alias("_k"))
    judged = kept(bounds.join(counted, keys) if keys else bounds.crossJoin(counted), "judged")
    enough = F.col("_k") >= F.greatest(F.lit(3), F.least(F.lit(5), F.col("n")))
    return beside(judged).where(~enough | inside).select(*df.columns)


def _groups(groups: DataFrame) -> DataFrame:
    """A row a group, for a join with the rows themselves: sent to the tasks if they are few, else merged. The planner, which knows only files' sizes, may send the rows through the driver."""
    counted = joins.small(groups)
    return counted if counted is not groups else groups.hint("merge")


def nearness(value: Column, target: Column, spread: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(value - target) / spread)


def targets(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, target, spread) of each group, kept."""
    return kept(profile(df, keys, value).select(*keys, "target", "spread"), "targets")


def scored(df: DataFrame, keys: list[str], value: str, p: DataFrame | None = None) -> DataFrame:
    """Adds score and distance against the group's own profile, or against targets that are known."""
    p = targets(df, keys, value) if p is None else p
    placed = df.join(_groups(p), keys) if keys else df.crossJoin(F.broadcast(p))
    return placed.withColumn("score", nearness(F.col(value), F.col("target"), F.col("spread"))).withColumn("distance", F.abs(F.col(value) - F.col("target"))).drop("target", "spread")


def distribution(df: DataFrame, key: str, weight: Column) -> DataFrame:
    """(key, weight): summed weights as shares of 1; left as they are if they already make 1."""
    sums = df.groupBy(key).agg(F.sum(weight).alias("_w"))
    total = F.sum("_w").over(Window.partitionBy(F.lit(0)))  # a row per bucket
    share = F.when((total > 0) & (F.abs(total - 1) > 1e-5 + 1e-8), F.try_divide(F.col("_w"), total)).otherwise(F.col("_w"))
    return sums.select(key, share.alias("weight"))
