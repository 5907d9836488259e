"""Joins beyond the plain ones: as-of, range, prefixed keys, multimaps of names, cascades, upserts."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators import intervals

#: Rows that one task sorts.
ROWS_A_TASK = 1_000_000
#: Rows and bytes of a side up to which it is worth sending to every task; larger ones are left to the planner.
SMALL_ROWS, SMALL_BYTES = 100_000, 32_000_000


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if counting its rows and their bytes as text finds it small; else left to the planner."""
    width = F.octet_length(F.to_json(F.struct("*"))) if df.columns else F.lit(0)
    n, size = df.limit(SMALL_ROWS + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return F.broadcast(df) if n <= SMALL_ROWS and (size or 0) <= SMALL_BYTES else df


def as_of(bars: DataFrame, key: str, ts: str, value: str, anchors: list[tuple[int, Column]]) -> DataFrame:
    """(key, anchor, value): each key's last value at or before each anchor; later bars win ties by value.

    One pass: every bar is offered to the anchors at or after it (their number is fixed) and partial maxima are combined
    before the shuffle, so a key with most of the bars is no hot spot.
    """
    offered = F.explode(F.filter(F.array(*[F.struct(F.lit(n).alias("anchor"), at.alias("at")) for n, at in anchors]), lambda a: F.col(ts) <= a["at"]))
    rows = bars.withColumn("_a", offered)
    return rows.groupBy(key, F.col("_a.anchor").alias("anchor")).agg(F.max(F.struct(ts, value)).alias("_m")).select(key, "anchor", F.col(f"_m.{value}").alias(value))


def anchor_returns(values: DataFrame, key: str, value: str, needed: int) -> DataFrame:
    """(key, average_return): mean percent change between successive anchors (0 the latest), four places; keys with fewer anchors are left out."""
    pairs = values.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("anchor", value))).alias("a")).where(F.size("a") == needed)
    changes = F.zip_with(F.slice("a", 1, needed - 1), F.slice("a", 2, needed - 1), lambda new, old: F.try_divide(new[value], old[value]) - 1)
    mean = F.aggregate(changes, F.lit(0.0), lambda s, x: s + x) / (needed - 1)
    return pairs.select(key, F.bround(mean * 100, 4).alias("average_return"))


#: Ranges up to which every row is held against each of them; more are joined by intervals.
FEW_RANGES = 64


def in_range(df: DataFrame, value: Column, ranges: DataFrame, low: str, high: str, closed_top: float | None = None) -> DataFrame:
    """Left join with the half-open ranges that hold the value; the top one includes its end."""
    if ranges.limit(FEW_RANGES + 1).count() > FEW_RANGES:
        return intervals.within(df, value, ranges, low, high, closed_top)
    inside = (value >= F.col(low)) & ((value < F.col(high)) | ((value == F.col(high)) & (F.col(high) == F.lit(closed_top)) if closed_top is not None else F.lit(False)))
    return df.join(F.broadcast(ranges), inside, "left")


def right_by_prefixed_key(left: DataFrame, left_key: str, right: DataFrame, right_key: str, prefix: str) -> DataFrame:
    """Every row of right, with those of left whose number follows the prefix in right's key. Columns of both sides: _x and _y."""
    both = {c for c in left.columns if c in right.columns}
    a = left.select(*[F.col(c).alias(f"{c}_x" if c in both else c) for c in left.columns])
    b = right.select(*[F.col(c).alias(f"{c}_y" if c in both else c) for c in right.columns])
    key = F.regexp_replace(F.trim(F.col(f"{right_key}_y" if right_key in both else right_key)), f"^{prefix}", "").try_cast("bigint")
    return a.join(b, F.col(f"{left_key}_x" if left_key in both else left_key) == key, "right")


def name_hits(people: DataFrame, person: str, names: list[Column], listed: DataFrame, entry: str, keys: Column, source: str) -> DataFrame:
    """(person, source, hits): entries of a list whose keys (an array) hold one of a person's names. One hit per entry."""
    probe = people.select(F.col(person), F.explode(F.array_distinct(F.array(*names))).alias("key")).where(F.col("key") != "")
    table = listed.select(F.col(entry).alias("entry"), F.explode(F.array_distinct(keys)).alias("key")).where(F.col("key") != "")
    hits = probe.join(table, "key").select(person, "entry").distinct()
    return hits.groupBy(person).agg(F.sort_array(F.collect_list("entry")).alias("hits")).select(person, F.lit(source).alias("source"), "hits")


def first_match(wanted: DataFrame, key: str, feeds: list[tuple[DataFrame, list[str]]], row_id: str) -> DataFrame:
    """wanted with `match` (struct of all columns as JSON) of the first feed, column and row whose text equals the key, blanks and case aside."""
    upper = lambda c: F.upper(F.trim(c.cast("string")))
    stacked = []
    for n, (feed, columns) in enumerate(feeds):
        present = [c for c in columns if c in feed.columns]
        choices = F.array(*[F.struct(F.lit(n).alias("feed"), F.lit(i).alias("place"), upper(F.col(f"`{c}`")).alias("key")) for i, c in enumerate(present)])
        stacked.append(feed.select(F.explode(choices).alias("c"), F.col(row_id).cast("string").alias("row"), F.to_json(F.struct("*")).alias("match")).select("c.*", "row", "match"))
    table = reduce(DataFrame.unionByName, stacked).where("key is not null and key <> ''")
    best = table.groupBy(F.col("key").alias("_key")).agg(F.min_by("match", F.struct("feed", "place", "row")).alias("match"), F.min(F.struct("feed", "place", "row")).alias("_at"))
    return wanted.join(best.select("_key", "match", F.col("_at.feed").alias("feed")), upper(F.col(key)) == F.col("_key"), "left").drop("_key")


def upserted(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with the changes' rows in place of those of the same key, and new ones added."""
    fresh = changes.groupBy(key).agg(F.max(F.struct(*[c for c in changes.columns if c != key])).alias("_n")).select(key, "_n.*")
    return table.join(fresh, key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def updated(table: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """table with the values set in all rows that meet the condition."""
    return table.withColumns({k: F.when(where, v).otherwise(F.col(k)) for k, v in values.items()})


def first_deleted(table: DataFrame, where: Column, key: str) -> DataFrame:
    """table without the row of least key among those that meet the condition."""
    least = table.where(where).agg(F.min(key).alias("_least"))
    return table.join(F.broadcast(least), F.col(key) == F.col("_least"), "left_anti")


def resolved(people: DataFrame, key: Column, wanted: Column) -> DataFrame:
    """(n, id): how many rows have the wanted key, and the id if it is one; more raise."""
    n = F.count(F.lit(1))
    return people.where(key == wanted).agg(n.alias("n"), F.when(n > 1, F.raise_error(F.lit("several rows match"))).otherwise(F.min("id")).alias("id"))


def integrity(child: DataFrame, foreign: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child whose key is set and not in parent."""
    return child.where(F.col(foreign).isNotNull()).join(parent.select(F.col(key).alias(foreign)).distinct(), foreign, "left_anti")


def carried(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the last value that is not null up to each row."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(frame))


def carried_in_parts(df: DataFrame, keys: list[str], part: str, order: list[Column], value: Column, name: str, rows: int | None = None) -> DataFrame:
    """As carried, where rows of a key come in parts (splits of a file) that follow one another: no task holds more than a part.

    The last value of each part goes, over the parts (a row each), to the parts behind it; within a part rows take their own.
    Parts are dealt to tasks by their number of rows, so that a task sorts as much of a large table as of a small one (rows: at least
    their number, where it is known).
    """
    tasks = max(1, math.ceil((df.count() if rows is None else rows) / ROWS_A_TASK))
    valued = df.withColumn("_value", value).repartition(max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys, part)
    frame = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = valued.withColumn("_own", F.last("_value", ignorenulls=True).over(frame))
    lasts = valued.where("_value is not null").groupBy(*keys, part).agg(F.max_by("_value", F.struct(*order)).alias("_last"))
    parts = valued.select(*keys, part).distinct().join(lasts, [*keys, part], "left")
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(*keys, part, F.last("_last", ignorenulls=True).over(before).alias("_before"))
    return own.join(small(carry), [*keys, part]).withColumn(name, F.coalesce("_own", "_before")).drop("_value", "_own", "_before")
