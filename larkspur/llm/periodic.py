"""Periodic runs of words, found by matching blocks.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least max(12, 2q) words
long, that no neighbouring word extends. Periods are searched by scale: at scale B, a power of two, those from 2B - 1 to
4B - 2. Each run of such a period holds a block of B words that begins at a multiple of B and occurs again one period
later. An automaton (pyahocorasick, keys of word numbers) of all aligned blocks is run over the stretch; occurrences at a
distance of the scale are seeds, and each is extended exactly in both directions. Of seeds of one distance whose blocks
touch, one is extended. A run with several periods comes at several scales: the smallest is kept.

Only stretches that can hold a run are searched: each four words of a run occur again within its period, which is at most
half of the stretch, so words in no such four are left out, until nothing more falls away. Words are numbered by value, not
by hash; hashes of four words only decide what is searched.

Edge cases: a null text has no words; a null doc_id is carried through (and never planted); repeated rows are rows of their
own; an empty table gives an empty result; other columns are ignored, also with clashing names. A text is one task's work
and is held whole, with about 60 bytes a word beside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import column_bytes, runs_of

LEAST_WORDS = 12
GRAM = 4
#: Bytes of text numbered at once (one longer text is numbered alone).
RUN_BYTES = 4_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
Run = tuple[int, int, int]


@dataclass
class Numbered:
    """Words of some texts: numbers by value, byte spans, and where each text's begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    value: np.ndarray


def numbered(data: np.ndarray, offsets: np.ndarray) -> Numbered:
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = ~word[:-1], ~word[1:]
    start = np.flatnonzero(word & (before | edge[:-1]))
    end = np.flatnonzero(word & (after | edge[1:])) + 1
    at = np.concatenate(([0], np.cumsum(end - start)))
    column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data[word].tobytes())])
    value = np.asarray(column.dictionary_encode().indices).astype(np.int64) if len(start) else np.zeros(0, np.int64)
    return Numbered(data, start, end, np.searchsorted(start, offsets), value)


def stretches(value: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first word, end, least distance): where four words in a row occur again, near enough for a run."""
    n = len(value) - GRAM + 1
    if n <= 0:
        return
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    gram = text[:n].astype(np.uint64) * _FACTORS[3]
    for i in range(GRAM):
        gram = (gram + value[i : i + n].astype(np.uint64)) * _FACTORS[i % 3]
        gram ^= gram >> np.uint64(29)
    place = (gram >> np.uint64(64 - max(10, int(n).bit_length()))).astype(np.int64)
    at = np.flatnonzero((np.bincount(place)[place] > 1) & (text[:n] == text[GRAM - 1 :]))
    at = at[np.argsort(gram[at], kind="stable")]
    same = (gram[at[1:]] == gram[at[:-1]]) & (text[at[1:]] == text[at[:-1]])
    apart = np.diff(at)
    near = np.full(len(at), np.iinfo(np.int64).max)
    near[:-1][same] = apart[same]
    near[1:][same] = np.minimum(near[1:][same], apart[same])
    order = np.argsort(at)
    at, near = at[order], near[order]
    while len(at):
        first = np.ones(len(at), bool)
        first[1:] = (at[1:] > at[:-1] + GRAM) | (text[at[1:]] != text[at[:-1]])
        begin = np.flatnonzero(first)
        stop = np.append(begin[1:], len(at))
        length = at[stop - 1] + GRAM - at[begin]
        each = np.repeat(length, stop - begin)
        keep = (each >= LEAST_WORDS) & (near <= each // 2)
        if keep.all():
            yield from zip(at[begin].tolist(), (at[begin] + length).tolist(), np.minimum.reduceat(near, begin).tolist(), strict=True)
            return
        at, near = at[keep], near[keep]


def equal_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements of a and b are equal."""
    n, at, step = min(len(a), len(b)), 0, 64
    a, b = a[:n], b[:n]
    while at < n:
        differ = a[at : at + step] != b[at : at + step]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + len(differ), step * 4
    return n


def block_seeds(words: tuple[int, ...], block: int) -> tuple[np.ndarray, np.ndarray]:
    """Places x and distances q, one of each chain of touching blocks: the aligned block at x occurs at x + q, 2 block - 1 <= q <= 4 block - 2."""
    keys, names = {}, []
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for x in range(0, len(words) - block + 1, block):
        key = words[x : x + block]
        name = keys.setdefault(key, len(keys))
        if name == len(keys) - 1:
            automaton.add_word(key, name)
        names.append(name)
    automaton.make_automaton()
    found = np.array(list(automaton.iter(words)), np.int64).reshape(-1, 2)
    y, name, names = found[:, 0] - block + 1, found[:, 1], np.array(names)
    xs, qs = [], []
    for back in (1, 2):
        x = (y - 2 * block + 1) // block - (back - 1)
        fit = (x >= 0) & (y - x * block <= 4 * block - 2)
        fit[fit] = names[x[fit]] == name[fit]
        xs.append(x[fit])
        qs.append((y - x * block)[fit])
    x, q = np.concatenate(xs), np.concatenate(qs)
    key = np.sort(q * (len(names) + 1) + x)
    key = key[np.append(True, np.diff(key) > 1)] if len(key) else key
    return key % (len(names) + 1) * block, key // (len(names) + 1)


def runs_between(value: np.ndarray, lo: int, hi: int, least: int) -> dict[tuple[int, int], int]:
    """(start, end) -> smallest period of the runs that lie between two places of a text; least: a bound below their periods."""
    words = tuple(value[lo:hi].tolist())
    found: dict[tuple[int, int], int] = {}
    held = np.zeros((3, hi - lo), np.int64)  # of the longest run with many periods so far, at each place: start, end, period
    block = 1
    while 2 * (2 * block - 1) <= hi - lo:
        if least <= 4 * block - 2:
            x, q = block_seeds(words, block)
            start, end, period = held[:, x]
            # Where a run has period p, a multiple of p has the same stretch: nothing new to extend.
            known = (period > 0) & (start <= x + lo) & (x + lo + q + block <= end) & (end - start >= q + period)
            known[known] = q[known] % period[known] == 0
            for x0, q0 in zip((x[~known] + lo).tolist(), q[~known].tolist(), strict=True):
                if held[2, x0 - lo] and held[1, x0 - lo] >= x0 + q0 + block and q0 % held[2, x0 - lo] == 0 and held[1, x0 - lo] - held[0, x0 - lo] >= q0 + held[2, x0 - lo]:
                    continue
                end0 = x0 + q0 + equal_ahead(value[x0:], value[x0 + q0 :])
                start0 = x0 - equal_ahead(value[:x0][::-1], value[: x0 + q0][::-1])
                if end0 - start0 >= max(LEAST_WORDS, 2 * q0):
                    found[start0, end0] = min(q0, found.get((start0, end0), q0))
                    if end0 - start0 >= 4 * q0:
                        part = slice(max(0, start0 - lo), end0 - lo)
                        longer = held[1, part] - held[0, part] < end0 - start0
                        held[:, part][:, longer] = np.array([[start0], [end0], [q0]])
        block *= 2
    return found


def runs_of_texts(value: np.ndarray, bounds: np.ndarray) -> list[list[Run]]:
    """Per text its runs (start, length, period), by start, then period."""
    found: list[dict] = [{} for _ in bounds[1:]]
    for lo, hi, least in stretches(value, bounds):
        i = int(np.searchsorted(bounds, lo, side="right")) - 1
        base = int(bounds[i])
        for span, q in runs_between(value[base : bounds[i + 1]], lo - base, hi - base, least).items():
            found[i][span] = min(q, found[i].get(span, q))
    return [sorted((s, e - s, q) for (s, e), q in f.items()) for f in found]


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a document that is made periodic; None where it is not."""
    if doc_id is None or not n:
        return None
    g, rest = divmod(crc32(str(doc_id).encode()), 10)
    if rest:
        return None
    a = g % n
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return place


@dataclass
class Read:
    """One text: its runs, and its words without repeated periods, as bytes."""

    runs: list[Run]
    collapsed: bytes


def read(ids: list[int | None], column: pa.Array, plant: bool) -> Iterator[Read]:
    """Each text of a column, in order."""
    data, offsets = column_bytes(column)
    for i, j in runs_of(offsets, RUN_BYTES):
        part = numbered(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        source = np.arange(len(part.value))
        for k in range(j - i) if plant else ():
            lo, hi = int(part.bounds[k]), int(part.bounds[k + 1])
            place = planted(ids[i + k], hi - lo)
            if place is not None:
                source[lo:hi] = lo + place
        whole = part.data.tobytes()
        found = runs_of_texts(part.value[source], part.bounds)
        for k, runs in enumerate(found):
            lo, hi = int(part.bounds[k]), int(part.bounds[k + 1])
            left = source[lo:hi][kept_words(hi - lo, runs)] if runs else source[lo:hi]
            yield Read(runs, b" ".join([whole[a:b] for a, b in zip(part.start[left].tolist(), part.end[left].tolist(), strict=True)]))


def _mapped(docs: DataFrame, schema: str, plant: bool, rows_of) -> DataFrame:
    """rows_of(doc_id, Read) for each document, as rows of the schema."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    fields = [c.split() for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string()}[k] for _, k in fields]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [r for doc_id, found in zip(ids, read(ids, batch.column("text"), plant), strict=True) for r in rows_of(doc_id, found)]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * len(kinds), kinds, strict=True)], names=[n for n, _ in fields])

    return plain.mapInArrow(each, schema)


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period) of every run of every text, in words from 0."""
    return _mapped(docs, "doc_id long, start long, length long, period long", False, lambda doc_id, found: [(doc_id, *r) for r in found.runs])


def collapsed(docs: DataFrame) -> DataFrame:
    """(doc_id, text): each text's words, joined by one space, with one period of each run."""
    return _mapped(docs, "doc_id long, text string", False, lambda doc_id, found: [(doc_id, found.collapsed.decode())])


def _digest(doc_id: int | None, found: Read) -> list[tuple]:
    start, length, period = min(found.runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found.runs)
    exponent = 1000 * length // period if period else None
    return [(doc_id, len(found.runs), start, length, period, exponent, sha256(listed.encode()).hexdigest(), sha256(found.collapsed).hexdigest())]


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns, over texts of which a tenth are made periodic."""
    return _mapped(docs, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string", True, _digest)
