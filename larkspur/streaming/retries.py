"""Work that is tried again: attempts a document as state, with timers, instead of a look at the whole ledger in each batch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: A document's state: attempts so far, when it was last tried, and whether it is done or given up.
STATE = "attempts int, at timestamp, over boolean"
OUTCOMES = "document_id long, attempts int, outcome string"


class Attempts(StatefulProcessor):
    """Outcomes of a document's attempts (at, status): `completed` with the first success, `failed` with the last try that is allowed; what comes later is not heard. A document that is not tried again within the wait is `overdue`.

    State holds a row a document, and a timer while it is open. Late attempts beyond the watermark are dropped by Spark.
    """

    def __init__(self, most: int, wait_ms: int):
        self.most, self.wait_ms = most, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempts", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        attempts, last, over = self.state.get() if self.state.exists() else (0, None, False)
        for row in sorted(rows, key=lambda r: (r["at"], r["status"])):
            if over:
                break
            attempts, last = attempts + 1, row["at"]
            over = row["status"] == "completed" or attempts >= self.most
            if over:
                yield Row(document_id=key[0], attempts=attempts, outcome="completed" if row["status"] == "completed" else "failed")
        self.state.update((attempts, last, over))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not over:
            self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs(), int(last.timestamp() * 1000)) + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        attempts, last, _ = self.state.get()
        self.state.update((attempts, last, True))
        yield Row(document_id=key[0], attempts=attempts, outcome="overdue")

    def close(self) -> None:
        pass


def outcomes(attempts: DataFrame, most: int = 3, wait_minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """(document_id, attempts, outcome) of a stream of (document_id, at, status), one row a document. Needs the RocksDB state store."""
    timed = attempts.select(F.col("document_id").cast("long").alias("document_id"), F.col("at").cast("timestamp").alias("at"), "status").withWatermark("at", late)
    return timed.groupBy("document_id").transformWithState(Attempts(most, wait_minutes * 60_000), OUTCOMES, "Append", "EventTime")


def outcomes_of_batch(attempts: DataFrame, most: int = 3) -> DataFrame:
    """The same of a whole table, where nothing is overdue yet: documents that are done or given up."""
    listed = attempts.select(F.col("document_id").cast("long").alias("document_id"), F.struct("at", "status").alias("a"))
    numbered = listed.withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy("a"))).where(F.col("n") <= most)
    ended = numbered.where((F.col("a.status") == "completed") | (F.col("n") == most))
    first = ended.groupBy("document_id").agg(F.min(F.struct("n", F.col("a.status").alias("status"))).alias("m"))
    return first.select("document_id", F.col("m.n").cast("int").alias("attempts"), F.when(F.col("m.status") == "completed", "completed").otherwise("failed").alias("outcome"))


def first_differences(snapshots: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """Of a stream of snapshot rows each new combination of the keys, once within the watermark."""
    return snapshots.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
