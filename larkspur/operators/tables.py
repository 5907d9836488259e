"""Tables that are upserted again and again: bucketed by key, so that the table's side is not shuffled."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new table.
BUCKETS = 64


def unused(name: str) -> str:
    """A table name that nothing has yet."""
    return f"{name}_{uuid.uuid4().hex}"


def create(df: DataFrame, name: str, key: str, buckets: int = BUCKETS) -> None:
    """Writes a table of the session's catalogue, bucketed and sorted by key."""
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name)


def merged(spark: SparkSession, name: str, changes: DataFrame, key: str) -> DataFrame:
    """The table with the changes' columns in place of its own for rows of the same key, and new rows added; columns that the changes lack stay. Of several changes of a key the greatest row wins.

    A full outer join on the bucketing key: only the changes are shuffled.
    """
    table = spark.table(name)
    others = [c for c in changes.columns if c != key]
    last = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*others)).alias("_n"))
    met = table.withColumn("_old", F.lit(True)).join(last, key, "full_outer")
    fresh = lambda c: F.when(F.col("_n").isNotNull(), F.col("_n")[c]).otherwise(F.col(c)) if c in others else F.col(c)
    return met.select(*[F.col(c) if c == key else fresh(c).alias(c) for c in table.columns])


def upsert(spark: SparkSession, name: str, changes: DataFrame, key: str, buckets: int = BUCKETS) -> None:
    """Merges changes into the table. The new rows are written beside the old ones, bucketed alike, and take the name when they are whole."""
    beside, old = unused(name), unused(name)
    merged(spark, name, changes, key).write.bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(beside)
    spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {beside} RENAME TO {name}")
    spark.sql(f"DROP TABLE {old}")
