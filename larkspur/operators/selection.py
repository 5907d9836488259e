"""Row selection: predicates, projections, latest rows, top rows, batches."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DateType, DoubleType, FloatType, MapType, StructType, TimestampNTZType, TimestampType

from larkspur.functions.numbers import any_of
from larkspur.operators import ranks


def where_equal(df: DataFrame, query: Mapping[str, object], ignore_unknown: bool = False, allow_lists: bool = True) -> DataFrame:
    """Rows that equal the query's values (a list, tuple or set: any of them; None: null). Unknown columns raise unless ignored."""
    for name, value in query.items():
        if name not in df.columns:
            if ignore_unknown:
                continue
            raise ValueError(f"no column {name!r}")
        if isinstance(value, list | tuple | set):
            if not allow_lists:
                raise ValueError(f"lists are for reads only: {name!r}")
            df = df.where(F.col(name).isin(*value))
        else:
            df = df.where(F.col(name).eqNullSafe(F.lit(value)))
    return df


def without_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """All columns but those named; raises if none is left."""
    if not set(df.columns) - set(names):
        raise ValueError("no column is left")
    return df.drop(*names)


def guarded(df: DataFrame, query: Mapping[str, object], wide: str) -> DataFrame:
    """df, unless it is read whole with its wide column."""
    if not query and wide in df.columns:
        raise ValueError(f"read of {wide!r} without a filter")
    return df


def with_defaults(df: DataFrame, required: Mapping[str, str]) -> DataFrame:
    """The required columns (name: type) in order; missing ones are null."""
    return df.select(*[(F.col(f"`{n}`") if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in required.items()])


def known_columns(df: DataFrame, schema: list[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c in schema])


def capitalized(df: DataFrame) -> DataFrame:
    """Column names with the first letter upper and the rest lower case."""
    return df.toDF(*[c.capitalize() for c in df.columns])


def starts_with_any(c: Column, prefixes: tuple[str, ...]) -> Column:
    return any_of([c.startswith(p) for p in prefixes])


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in order, which has to be total."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def latest_files(files: DataFrame, day: Column, period: list[Column]) -> DataFrame:
    """Of files, those of the latest day of each period; a day that is null is left out."""
    placed = files.withColumn("_day", day).where(F.col("_day").isNotNull())
    names = [f"_p{i}" for i in range(len(period))]
    for n, p in zip(names, period, strict=True):
        placed = placed.withColumn(n, p)
    last = F.max("_day").over(Window.partitionBy(*names))
    return placed.withColumn("_last", last).where(F.col("_day") == F.col("_last")).drop("_last", "_day", *names)


def within_days(df: DataFrame, ts: Column, start=None, end=None) -> DataFrame:
    """Rows between the bounds given, both included; rows without a time go only if a bound is given."""
    if start is not None:
        df = df.where(ts >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(ts <= F.lit(end).cast("timestamp_ntz"))
    return df


def top(df: DataFrame, keys: list[str], order: list[Column], n: int | Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def numbered_batches(df: DataFrame, size: int, key: str, rows_a_task: int = ranks.ROWS_A_TASK) -> DataFrame:
    """Adds `batch`: the number of each row's batch of `size` in the order of a key without ties, over the whole table; all batches but the last are full."""
    return ranks.numbered(df, key, "_place", rows_a_task).withColumn("batch", F.floor(F.col("_place") / size)).drop("_place")


def split_valid(df: DataFrame, reasons: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with `reason`): the first test that holds gives the reason."""
    reason = F.lit(None).cast("string")
    for test, text in reversed(reasons):
        reason = F.when(test, F.lit(text)).otherwise(reason)
    judged = df.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def union_tagged(parts: list[tuple[DataFrame, Mapping[str, object]]], first: list[str]) -> DataFrame:
    """Union by name of tagged parts, missing columns null, with the columns of `first` in front."""
    out = None
    for df, tags in parts:
        tagged = df.withColumns({k: F.lit(v) for k, v in tags.items()})
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("nothing to unite")
    return out.select(*first, *[c for c in out.columns if c not in first])


def by_creation(df: DataFrame, created: str = "created", key: str = "id") -> DataFrame:
    """Rows by their stamp as text, those without one first; ties by key."""
    return df.orderBy(F.coalesce(F.col(created).cast("string"), F.lit("")), key)


def json_safe(df: DataFrame) -> DataFrame:
    """Rows as JSON can hold them: NaN and infinite numbers are null, times are ISO text, map keys are text; inside arrays, structs and maps too."""

    def safe(c: Column, kind: DataType) -> Column:
        if isinstance(kind, DoubleType | FloatType):
            return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
        if isinstance(kind, DateType):
            return F.date_format(c, "yyyy-MM-dd")
        if isinstance(kind, TimestampType | TimestampNTZType):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        if isinstance(kind, ArrayType):
            return F.transform(c, lambda x: safe(x, kind.elementType))
        if isinstance(kind, MapType):
            return F.map_from_entries(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("string").alias("key"), safe(e["value"], kind.valueType).alias("value"))))
        if isinstance(kind, StructType):
            return F.when(c.isNotNull(), F.struct(*[safe(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return c

    return df.select(*[safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
