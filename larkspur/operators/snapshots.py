"""Snapshots: order-free signatures, differences, duplicates by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row's columns in order of name, nulls as empty text."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in sorted(df.columns)]
    return F.sha2(F.to_json(F.struct(*cells)), 256)


def signature(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, rows, signature): of the multiset of the other columns' rows of each key, whatever their order.

    A row's digest in four parts of sixteen hexadecimal digits, summed: partial sums are combined, so no task sees all
    rows of a key.
    """
    digest = row_digest(df.drop(*keys))
    parts = [F.conv(F.substring(digest, 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = F.concat_ws(":", F.count(F.lit(1)).cast("string"), *[F.coalesce(F.sum(p), F.lit(0)).cast("string") for p in parts])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sha2(sums, 256).alias("signature"))


def change_summary(new: DataFrame, old: DataFrame, samples: int = 3) -> DataFrame:
    """One row: how many distinct rows were added and removed, and the first few of each, as JSON in order of their text."""
    as_text = lambda df: df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])).alias("row")).distinct()
    a, b = as_text(new), as_text(old)
    changes = a.join(b, "row", "left_anti").withColumn("change", F.lit("added")).unionByName(b.join(a, "row", "left_anti").withColumn("change", F.lit("removed")))
    firsts = lambda change: changes.where(F.col("change") == change).orderBy("row").limit(samples).agg(F.sort_array(F.collect_list("row")).alias(f"{change}_samples"))
    counts = changes.agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"))
    return counts.crossJoin(firsts("added")).crossJoin(firsts("removed"))  # one row each


def differences(new: DataFrame, old: DataFrame) -> DataFrame:
    """Distinct rows added and removed, with `change`; duplicates collapse."""
    names = sorted(new.columns)
    a, b = new.select(*names), old.select(*names)
    return a.subtract(b).withColumn("change", F.lit("added")).unionByName(b.subtract(a).withColumn("change", F.lit("removed")))


def compared(new: DataFrame | None, old: DataFrame | None) -> DataFrame:
    """One row: which snapshots there are, whether they are the same multiset, and how many distinct rows came and went."""
    held = new if new is not None else old
    if held is None:
        raise ValueError("no snapshot")
    if new is None or old is None:
        return signature(held).select(F.lit(new is not None).alias("has_new"), F.lit(old is not None).alias("has_old"), F.lit(None).cast("boolean").alias("is_same"), F.lit(None).cast("long").alias("added"), F.lit(None).cast("long").alias("removed"))
    changes = differences(new, old).agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"))
    same = signature(new).select(F.col("signature").alias("n")).crossJoin(signature(old).select(F.col("signature").alias("o")))  # one row each
    return same.crossJoin(changes).select(F.lit(True).alias("has_new"), F.lit(True).alias("has_old"), (F.col("n") == F.col("o")).alias("is_same"), "added", "removed")


def duplicate_groups(df: DataFrame, content: Column, key: str) -> DataFrame:
    """(digest, n, first) of contents that occur more than once."""
    return df.groupBy(F.sha1(content).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).where("n > 1")
