"""Joins by containment as equi-joins: values in ranges, points in boxes.

Ranges are dealt to the places of the values that they hold. Boxes use levels: a box belongs to a level whose cells are about
as wide as itself, so it touches few cells, however wide it is, and a point looks up one cell in each level that is in use; the
exact test follows. These are equi-joins, which can be shuffled and, where skewed, split; no plan holds a nested loop.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.shared import kept

#: Cuts between buckets of values: they bound what the driver holds of the ranges' distribution.
CUTS = 1023


def cuts_of(ranges: DataFrame, columns: list[str], cuts: int = CUTS) -> list[float]:
    """Ascending cuts at quantiles of the columns' values."""
    found = ranges.select(*[F.col(c).cast("double").alias(c) for c in columns]).approxQuantile(columns, [(i + 1) / (cuts + 1) for i in range(cuts)], 0.5 / (cuts + 1))
    ends = sorted({x for column in found for x in column})
    step = max(1, math.ceil(len(ends) / cuts))
    return ends[::step]


def bucket(value: Column, cuts: list[float]) -> Column:
    """How many cuts are not above the value, by binary search."""
    if not cuts:
        return F.when(value.isNotNull(), F.lit(0))
    held = F.array(*[F.lit(c) for c in cuts])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) <= value, at + step).otherwise(at))
    return F.when(value.isNotNull(), found)


#: Places that one row of a wide range is dealt to at a time.
PLACES = 4096


def within(df: DataFrame, value: Column, ranges: DataFrame, low: str, high: str, closed_top: float | None = None, cuts: int = CUTS) -> DataFrame:
    """Left join of df with all half-open ranges that hold its value; one whose high is closed_top includes it.

    Distinct values have places in their order; a range holds the places from its low's to its high's, so it is dealt to these
    alone and meets nothing that it does not hold, however the ranges lie and however many values fall between two cuts.
    Cuts only decide which task counts which values.
    """
    number = value.cast("double")
    spans = ranges.withColumns({"_from": F.col(low).cast("double"), "_to": F.col(high).cast("double")}).where("_from <= _to")
    points = df.select(number.alias("_at"), F.lit(1).alias("_held")).where("_at is not null").unionByName(spans.select(F.explode(F.array("_from", "_to")).alias("_at"), F.lit(0).alias("_held")))
    # -0.0 and 0.0 are one value to a grouping, as to a comparison
    parted = points.groupBy("_at").agg(F.max("_held").alias("_held")).withColumn("_part", bucket(F.col("_at"), cuts_of(ranges, [low, high], cuts)))
    parted = kept(parted, "points")
    counts = parted.groupBy("_part").agg(F.sum("_held").alias("_n"))  # a row between two cuts
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    order = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    counted = parted.withColumn("_upto", F.sum("_held").over(order)).join(F.broadcast(before), "_part")
    places = kept(counted.select("_at", "_held", (F.col("_before") + F.col("_upto") - F.col("_held")).alias("_place")), "places")
    first = places.select(F.col("_at").alias("_from"), F.col("_place").alias("_first"))
    top = (F.col(high) == F.lit(closed_top)).cast("int") * F.col("_held") if closed_top is not None else F.lit(0)
    last = places.select(F.col("_at").alias("_to"), F.col("_place").alias("_next"), "_held")
    placed = spans.join(first, "_from").join(last, "_to").withColumn("_last", F.col("_next") + top - 1).where("_first <= _last").drop("_from", "_to", "_held", "_next")
    blocks = placed.withColumn("_begin", F.explode(F.sequence("_first", "_last", F.lit(PLACES).cast("long"))))
    dealt = blocks.withColumn("_place", F.explode(F.sequence("_begin", F.least(F.col("_last"), F.col("_begin") + PLACES - 1)))).drop("_first", "_last", "_begin")
    of_value = places.where("_held = 1").select("_at", "_place")
    return df.join(of_value, number == F.col("_at"), "left").drop("_at").join(dealt, "_place", "left").drop("_place")


#: Cells are never smaller than 2**LEAST_LEVEL: smaller boxes share them.
LEAST_LEVEL = -20
#: Powers of two by which a box may lie in cells larger or smaller than its own level's.
COARSER, FINER = 3, 4


def levels_in_use(sizes: list[tuple[int, int, float, float, float]], points: int) -> dict[int, int]:
    """Level of the boxes' own -> level that they are put in: those with the fewest rows of points (one a level in use) and boxes (one a cell).

    sizes: of each level the number of boxes, and the sums of their widths, heights and areas, which tell their mean number of
    cells of any size. From all levels, the one whose absence saves most is left out until none does.
    """
    cells = lambda n, at: n[1] + (n[2] + n[3]) / 2.0**at + n[4] / 4.0**at
    reach = {n[0]: {at: cells(n, at) for at in range(n[0] - FINER, n[0] + COARSER + 1)} for n in sizes}

    def placed(used: set[int]) -> tuple[float, dict[int, int]]:
        chosen = {n: min((at for at in used if at in costs), key=lambda at: (costs[at], at), default=None) for n, costs in reach.items()}
        if None in chosen.values():
            return math.inf, chosen
        return points * len(used) + sum(reach[n][at] for n, at in chosen.items()), chosen

    used = set(reach)
    best, chosen = placed(used)
    while len(used) > 1:
        cost, gone = min((placed(used - {at})[0], at) for at in used)
        if cost > best:
            break
        used, best = used - {gone}, cost
        chosen = placed(used)[1]
    return chosen


def inside(points: DataFrame, x: str, y: str, boxes: DataFrame, sides: tuple[str, str, str, str], keys: list[str]) -> DataFrame:
    """Pairs of points and boxes of the same keys (a page) whose box (left, top, right, bottom, all included) holds the point.

    A grid index: a box has a level by its extent, and a point looks up its cell in each level in use. Levels near one another
    are put together where that makes fewer rows, so that points are not sent once for each size of box.
    """
    left, top, right, bottom = sides
    width, height = F.col(right) - F.col(left), F.col(bottom) - F.col(top)
    extent = F.greatest(width, height)
    far = F.greatest(*[F.abs(F.col(c)) for c in sides])
    exact = lambda c: F.ceil(F.log2(c))  # noqa: E731  (null for 0)
    level = F.greatest(F.coalesce(exact(extent), F.lit(LEAST_LEVEL)), F.lit(LEAST_LEVEL), F.coalesce(exact(far), F.lit(LEAST_LEVEL)) - 50).cast("int")
    sized = boxes.where((F.col(left) <= F.col(right)) & (F.col(top) <= F.col(bottom))).withColumn("_level", level)
    sizes = sized.groupBy("_level").agg(F.count(F.lit(1)), F.sum(width), F.sum(height), F.sum(width * height)).collect()  # at most one for each exponent of a double
    chosen = levels_in_use([tuple(r) for r in sizes], points.count() if len(sizes) > 1 else 0)
    levels = sorted(set(chosen.values()))
    cell = lambda c, n: F.floor(c / F.pow(F.lit(2.0), n))
    table = F.create_map(*[F.lit(v) for pair in sorted(chosen.items()) for v in pair]) if chosen else None
    leveled = sized.withColumn("_level", F.try_element_at(table, F.col("_level"))) if chosen else sized
    spread = lambda low, high: F.sequence(cell(F.col(low), F.col("_level")), cell(F.col(high), F.col("_level")))
    gridded = leveled.withColumn("_column", F.explode(spread(left, right))).withColumn("_row", F.explode(spread(top, bottom)))
    looked = F.array(*[F.struct(F.lit(n).alias("l"), cell(F.col(x), F.lit(n)).alias("c"), cell(F.col(y), F.lit(n)).alias("r")) for n in levels]) if levels else F.array().cast("array<struct<l:int,c:bigint,r:bigint>>")
    asked = points.withColumn("_a", F.explode(looked)).withColumns({"_level": F.col("_a.l"), "_column": F.col("_a.c"), "_row": F.col("_a.r")}).drop("_a")
    met = asked.join(gridded, [*keys, "_level", "_column", "_row"])
    held = F.col(x).between(F.col(left), F.col(right)) & F.col(y).between(F.col(top), F.col(bottom))
    return met.where(held).drop("_level", "_column", "_row")
