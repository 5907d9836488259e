"""Shared helpers of the training-data operators: shared-folder tables, block keys and Arrow/numpy byte access."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one grouped task holds at once (a single longer document still forms one block).
BLOCK_BYTES = 12_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one for local masters; a cluster raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that they share")
        base = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.sparkContext.setCheckpointDir(base)
    return base


_TABLES: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet to the shared folder and reads it back. Removed by release(), or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def tables_written() -> int:
    """How many tables written() holds so far: a mark for release()."""
    return len(_TABLES)


def release(mark: int = 0, keep: int = 0) -> None:
    """Removes the tables that written() made after a mark, but for the last `keep`: for when what is derived from them is written."""
    while len(_TABLES) - keep > mark:
        spark, path = _TABLES.pop(mark)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _end() -> None:
    try:
        release()
    except Exception:  # the session is already gone; the folder is the cluster's to clean
        pass


def text_column(df: DataFrame, *keep: str) -> DataFrame:
    """doc_id as long, text with null as empty, and the columns named: other columns, also with clashing names, are left behind."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *[F.col(c) for c in keep])


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks of about block_bytes of text each; their number grows with the input, their size does not."""
    total = docs.agg(F.sum(F.octet_length("text") + F.lit(64)).alias("b")).first()["b"] or 0
    return max(1, math.ceil(total / block_bytes))


def in_blocks(docs: DataFrame, n: int) -> DataFrame:
    """Adds `block`, a hash of doc_id and text below n; equal rows share a block."""
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(n)).cast("int"))


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column, end to end, and the offset of each value (one more than values)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[offsets[0] : offsets[-1]] if bufs[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def long_column(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Longs of a column; null becomes the least long."""
    return np.asarray(column.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), dtype=np.int64) if isinstance(column, pa.Array) else np.concatenate([np.zeros(0, np.int64), *[long_column(c) for c in column.chunks]])


def runs_of(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of values whose bytes together stay below most (one value at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def blobs(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column out of consecutive slices of data; bounds counts its rows."""
    raw = np.ascontiguousarray(data)
    at = np.asarray(bounds, np.int64) * (raw.itemsize * int(np.prod(raw.shape[1:], dtype=np.int64)))
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending, by sorting (much faster on long arrays than by hashing)."""
    if not len(values):
        return values
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))]


# --- hashing of byte strings ---------------------------------------------------------------------------------------

_RNG = np.random.default_rng(20240501)
BYTE_VALUES = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit polynomial hash of each k-byte string of data, composed from hashes of powers of two; not yet mixed."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    power, length, part = BASE, 1, BYTE_VALUES[data]
    got, got_length = None, 0
    while True:
        if k & 1:
            if got is None:
                got, got_length = part, length
            else:
                n = len(data) - got_length - length + 1
                got = got[:n] * power + part[got_length : got_length + n]
                got_length += length
        k >>= 1
        if not k:
            return got
        n = len(part) - length
        part = part[:n] * power + part[length : length + n]
        power, length = np.multiply(power, power, dtype=np.uint64), length * 2


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values, by doubling."""
    length = 1
    while length * 2 <= w:
        h = np.minimum(h[:-length], h[length:])
        length *= 2
    return np.minimum(h[: len(h) - (w - length)], h[w - length :]) if length < w else h


#: Masks of the first 0 to 8 bytes of a little-endian word of eight.
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def value_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the strings data[start:end]: eight bytes at a time, each time mixed through. Strings of eight bytes at most collide only where their lengths differ."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    length = end - start
    h = mixed(length.astype(np.uint64) * BASE)
    live, at = np.arange(len(start)), 0
    while len(live):
        rest = length[live] - at
        h[live] = mixed(h[live] * BASE + (eight[start[live] + at] & _FIRST_BYTES[np.minimum(rest, 8)]))
        live, at = live[rest > 8], at + 8
    return h


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a run of texts, A-Z lower-cased: text number, byte span and 64-bit hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.n_texts = len(offsets) - 1
        low = _LOWER[data]
        space = _SPACE[data]
        word = ~space
        first = word.copy()
        first[1:] &= space[:-1]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        first |= word & edge[:-1]
        last = word.copy()
        last[:-1] &= space[1:]
        last |= word & edge[1:]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(offsets, self.start, side="right") - 1
        self.low = low
        self.hash = value_hashes(low, self.start, self.end)
        self.bounds = np.searchsorted(self.text, np.arange(self.n_texts + 1))
