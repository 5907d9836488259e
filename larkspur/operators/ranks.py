"""Places and quantiles of tables and groups that no one task can sort."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators import joins
from larkspur.shared import kept

#: Rows that one task numbers or sorts.
ROWS_A_TASK = 1_000_000
#: Values of one group's interval that are sorted in one row of a task, and bins that a larger interval is counted in.
SORTED_VALUES, BINS = 10_000, 1024


def numbered(df: DataFrame, key: str, name: str, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """Adds each row's place from 0 in the order of a key without ties, over the whole table.

    Rows go to ranges of the key and are kept so; places within a range follow from its own rows, and what is before a range
    from the counts of the others (a row each).
    """
    parts = max(1, math.ceil(df.count() / rows_a_task))
    dealt = kept(df.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_part").count()
    before = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return dealt.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + place).drop("_part", "_before")


def quantiles(df: DataFrame, keys: list[str], value: str, fractions: list[float], sorted_values: int = SORTED_VALUES, bins: int = BINS) -> DataFrame:
    """(keys, n, q): exact quantiles of each group by linear interpolation between neighbouring values, as an array. Values are finite; nulls do not count.

    Where all groups are small, Spark's own aggregate does it, also where they have few distinct values: these are counted first,
    and the aggregate takes the counts. Else by distributed selection: every wanted rank starts with its
    group's whole interval of values; rows of the intervals that are still large are counted in bins, combined before the
    shuffle, and each rank goes on with the interval of its bin, all groups in the same pass. What is left of an
    interval is sorted, at most sorted_values of it. No task holds a group.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    groups = df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(F.col(value).cast("double")).alias("_lo"), F.max(F.col(value).cast("double")).alias("_hi"), F.approx_count_distinct(value).alias("_distinct"))
    most, distinct = groups.agg(F.max("n"), F.max("_distinct")).first()
    if (most or 0) > sorted_values and 2 * distinct <= sorted_values:  # the estimate decides how, not what
        counted = df.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(value).alias("_n"))
        return counted.groupBy(*keys).agg(F.sum("_n").alias("n"), F.percentile("_v", F.array(*[F.lit(f) for f in fractions]), F.col("_n")).alias("q"))
    if (most or 0) <= sorted_values:
        return df.groupBy(*keys).agg(F.count(value).alias("n"), F.percentile(value, F.array(*[F.lit(f) for f in fractions])).alias("q"))
    groups = kept(groups.drop("_distinct"), "groups")
    positions = F.array(*[F.lit(f) * (F.col("n") - 1) for f in fractions])
    ranks = F.array_distinct(F.flatten(F.transform(positions, lambda p: F.array(F.floor(p), F.ceil(p)))))
    state = groups.where("n > 0").select(*keys, F.explode(ranks).alias("_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("n").alias("_inside"))
    while (state.where("_lo < _hi").agg(F.max("_inside")).first()[0] or 0) > sorted_values:
        state = kept(_refined(rows, state, keys, sorted_values, bins), "ranks")
    found = _sorted(rows, state, keys)
    held = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))  # two ranks a fraction
    joined = _beside(groups.select(*keys, "n"), held, keys, "left")

    def between(position):
        low, high = F.floor(position), F.ceil(position)
        a, b = F.try_element_at("_at", low), F.try_element_at("_at", high)
        return F.when(a == b, a).otherwise((high - position) * a + (position - low) * b)  # equal neighbours give their value, to the last bit

    q = F.when(F.col("n") > 0, F.transform(positions, between))
    return joined.select(*keys, "n", q.alias("q"))


def _beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joined by keys, nulls equal; without keys the right side is a row or a few."""
    if not keys:
        return left.crossJoin(F.broadcast(right)) if how == "inner" else left.join(F.broadcast(right), F.lit(True), how)
    named = right.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    met = F.lit(True)
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return left.join(named, met, how).drop(*[f"_k{i}" for i in range(len(keys))])


def _refined(rows: DataFrame, state: DataFrame, keys: list[str], sorted_values: int, bins: int) -> DataFrame:
    """The state after one round: ranks of large intervals go on with their bin."""
    large = (F.col("_lo") < F.col("_hi")) & (F.col("_inside") > sorted_values)
    open_ = state.where(large).select(*keys, "_lo", "_hi").distinct()
    met = _beside(rows, joins.small(open_), keys).where("_v between _lo and _hi")
    # Halves keep differences of large values finite.
    share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
    counted = met.groupBy(*keys, "_lo", "_hi", F.least(F.floor(share * bins), F.lit(bins - 1)).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    order = Window.partitionBy(*keys, "_lo", "_hi").orderBy("_bin")  # a row a bin
    steps = counted.withColumn("_before", F.sum("_n").over(order) - F.col("_n")).withColumnsRenamed({"_lo": "_was_lo", "_hi": "_was_hi"}).drop("_bin")
    asked = state.where(large)
    inside = (F.col("_lo") == F.col("_was_lo")) & (F.col("_hi") == F.col("_was_hi")) & (F.col("_rank") - F.col("_below") >= F.col("_before")) & (F.col("_rank") - F.col("_below") < F.col("_before") + F.col("_n"))
    moved = _beside(asked, steps, keys).where(inside).select(*keys, "_rank", F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), (F.col("_below") + F.col("_before")).alias("_below"), F.col("_n").alias("_inside"))
    return state.where(~large).unionByName(moved)


def _sorted(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _rank, _v): the values at the wanted ranks, out of small intervals or such of one value."""
    single = state.where("_lo = _hi").select(*keys, "_rank", F.col("_lo").alias("_v"))
    small = state.where("_lo < _hi")
    intervals = small.select(*keys, "_lo", "_hi").distinct()
    held = _beside(rows, joins.small(intervals), keys).where("_v between _lo and _hi").groupBy(*keys, "_lo", "_hi").agg(F.sort_array(F.collect_list("_v")).alias("_vs"))
    placed = _beside(small, held.withColumnsRenamed({"_lo": "_was_lo", "_hi": "_was_hi"}), keys).where("_lo = _was_lo and _hi = _was_hi")
    return single.unionByName(placed.select(*keys, "_rank", F.get("_vs", (F.col("_rank") - F.col("_below")).cast("int")).alias("_v")))
