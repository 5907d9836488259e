"""A stream over a landed table by a growing key: each run reads the rows that came behind the last one read, and no more than asked for.

    rows = keyed.next_rows(spark, folder, "id", 500, done=sink_so_far)
    rows.writeStream.option("checkpointLocation", c).trigger(availableNow=True).format("parquet").start(sink)

Offsets are keys, kept by the query's checkpoint: a run that stops goes on where its last finished batch ended, and a batch that is
repeated reads the same range of keys. Filters on the key reach the Parquet files, so a run reads the row groups it needs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType


FIRST, LAST = -(2**63), 2**63 - 1


def landed(path: str) -> ds.Dataset:
    store, at = fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)
    return ds.dataset(at, filesystem=store, format="parquet")


@dataclass
class Keys(InputPartition):
    """Rows of one file with after < key <= upto."""

    file: int
    after: int
    upto: int


class KeyedSource(DataSource):
    """Options: path, key (a column of whole numbers that grows), upto (the greatest key to read; unset: all there are)."""

    @classmethod
    def name(cls) -> str:
        return "keyed"

    def schema(self) -> StructType:
        return from_arrow_schema(landed(self.options["path"]).schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return KeyedReader(self.options["path"], self.options["key"], int(self.options.get("upto", LAST)), schema)


class KeyedReader(DataSourceStreamReader):
    def __init__(self, path: str, key: str, upto: int, schema: StructType):
        self.path, self.key, self.upto, self.schema = path, key, upto, schema

    def initialOffset(self) -> dict:
        return {"key": FIRST}

    def latestOffset(self) -> dict:
        """The greatest key there is, not above `upto`."""
        keys = (b.column(0) for b in landed(self.path).to_batches(columns=[self.key], filter=pc.field(self.key) <= self.upto))
        return {"key": max([FIRST, *(pc.max(column).as_py() for column in keys if len(column))])}

    def partitions(self, start: dict, end: dict) -> list[Keys]:
        """A partition for each file that holds keys of the range."""
        wanted = (pc.field(self.key) > start["key"]) & (pc.field(self.key) <= end["key"])
        fragments = list(landed(self.path).get_fragments())
        return [Keys(i, start["key"], end["key"]) for i, f in enumerate(fragments) if f.count_rows(filter=wanted)]

    def read(self, partition: Keys) -> Iterator[pa.RecordBatch]:
        wanted = (pc.field(self.key) > partition.after) & (pc.field(self.key) <= partition.upto)
        fragment = list(landed(self.path).get_fragments())[partition.file]
        yield from fragment.to_batches(columns=self.schema.names, filter=wanted)

    def commit(self, end: dict) -> None:
        """Nothing to let go of: the table stays."""


def next_rows(spark: SparkSession, path: str, key: str, most: int | None = None, done: DataFrame | None = None) -> DataFrame:
    """The stream of rows behind the greatest key of `done` (what the sink holds so far), `most` of them at most."""
    spark.dataSource.register(KeyedSource)
    reader = spark.readStream.format("keyed").option("key", key)
    if most is not None:
        after = done.agg(F.max(key)).first()[0] if done is not None else None
        behind = spark.read.parquet(path).select(key).where(F.col(key) > F.lit(FIRST if after is None else after))
        last = behind.orderBy(key).limit(most).agg(F.max(key)).first()[0]
        reader = reader.option("upto", str(last if last is not None else FIRST if after is None else after))
    return reader.load(path)
