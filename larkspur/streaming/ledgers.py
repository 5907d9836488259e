"""Streams: append-only ledgers that remember what is done, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream(spark: SparkSession, folder: str, schema, files_a_trigger: int = 100) -> DataFrame:
    """Parquet files as they land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def resumable(rows: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], ledger: str, checkpoint: str) -> StreamingQuery:
    """Runs `work` on the rows of each batch whose key the ledger does not hold as completed, and appends its rows (key, status, ...).

    Failed keys are tried again when they arrive again; a batch that is repeated after a failure adds no completed key twice.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
        if jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm):
            done = spark.read.parquet(ledger).where("status = 'completed'").select(key).distinct()
            batch = batch.join(done, key, "left_anti")
        work(batch.dropDuplicates([key])).write.mode("append").parquet(ledger)

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, kind: str, value: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, kind, n, total) of event-time windows, for batches and streams; streams drop what is later than `late`."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(ts, late)
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return timed.groupBy(window.alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) of runs of events of a key without a longer gap, for batches and streams; streams drop what is later than `late`."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(ts, late)
    return timed.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
