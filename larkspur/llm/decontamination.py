"""Benchmark decontamination by pigeonhole edit matching.

An item with a budget of e edits is cut into e + 1 pieces; a passage within the budget holds one piece unchanged. The
pieces of many items are found in one pass over a text (an automaton), and each hit's surroundings are verified with
Myers' bit-parallel edit distance. Texts and items are compared in lower case with white space collapsed.

Items go to the tasks in shards of at most SHARD_BYTES, one pass over the documents each, so what is broadcast is
bounded; with several shards the matches of each are written before the next is sent. Documents are not shuffled; a very
frequent item costs each document only its own verification.

Edge cases: null or empty texts and items match nothing; items below WHOLE_WORDS characters have no budget and are found
as whole words only; of several occurrences of an item in a document the best is reported, ties going to the first end;
repeated items and documents are reported for each of their distinct ids; a document with a null doc_id is searched, and
removed, like others; empty tables give an empty result; other columns are ignored here and kept by filtered().
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import unused, written

EDIT_SHARE, WHOLE_WORDS, SHARD_BYTES = 0.06, 20, 4_000_000
MATCH = "doc_id long, item_id long, start long, end long, distance int, item_chars int"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(length: int, share: float = EDIT_SHARE) -> int:
    return int(length * share) if length >= WHOLE_WORDS else 0


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """The item in edits + 1 pieces of nearly equal length, with their places."""
    n = edits + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def distances(pattern: str, text: str, anchored: bool) -> Iterator[int]:
    """After each character of text: the edit distance of pattern to what ends there and begins anywhere (anchored: at the text's beginning)."""
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    equal: dict[str, int] = {}
    for i, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | 1 << i
    plus, minus, score = mask, 0, m
    for c in text:
        eq = equal.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(horizontal | plus) & mask
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1 | anchored) & mask, down << 1 & mask
        plus, minus = down | ~(vertical | up) & mask, up & vertical
        yield score


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best approximate occurrence of pattern in text, or None beyond `most` edits."""
    best = None
    for at, score in enumerate(distances(pattern, text, False), 1):
        if score <= most and (best is None or score < best[0]):
            best = (score, at)
    return best


def start_of(pattern: str, text: str, end: int, distance: int) -> int:
    """Where the best occurrence that ends at `end` begins: the shortest prefix, of both reversed, at that distance."""
    back = text[max(0, end - len(pattern) - distance) : end][::-1]
    return end - next((j for j, x in enumerate(distances(pattern[::-1], back, True), 1) if x == distance), len(back))


def whole_words(item: str, text: str, begin: int) -> bool:
    """Whether no word goes on beyond the edges of an occurrence."""
    end = begin + len(item)
    joined_before = begin > 0 and item[0].isalnum() and text[begin - 1].isalnum()
    return not (joined_before or (end < len(text) and item[-1].isalnum() and text[end].isalnum()))


class Searcher:
    """Finds a shard of items in texts."""

    def __init__(self, items: list[tuple[int, str]], share: float):
        import ahocorasick

        self.items = [(i, t, budget(len(t), share)) for i, t in items]
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text, edits) in enumerate(self.items):
            for at, piece in pieces(text, edits):
                places.setdefault(piece, []).append((number, at))
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        self.automaton.make_automaton()
        self.known: dict[tuple[int, str], tuple[int, int] | None] = {}

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int, int]]:
        """(item_id, start, end, distance, item length), one for each item found: its best occurrence."""
        windows: dict[int, list[list[int]]] = {}
        for last, (length, found) in self.automaton.iter(text):
            for number, at in found:
                begin = last + 1 - length - at
                _, item, edits = self.items[number]
                if len(item) < WHOLE_WORDS and not whole_words(item, text, begin):
                    continue
                low, high = max(0, begin - edits), min(len(text), begin + len(item) + edits)
                held = windows.setdefault(number, [])
                if held and low <= held[-1][1] and held[-1][0] <= low:
                    held[-1][1] = max(high, held[-1][1])
                else:
                    held.append([low, high])
        for number, spans in windows.items():
            item_id, item, edits = self.items[number]
            best = None
            for low, high in spans:
                part = text[low:high]
                if (number, part) not in self.known:
                    if len(self.known) > 20_000:
                        self.known.clear()
                    self.known[number, part] = myers(item, part, edits)
                got = self.known[number, part]
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], low + got[1])
            if best:
                yield item_id, start_of(item, text, best[1], best[0]), best[1], best[0], len(item)


def item_shards(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """(item_id, text, shard) of items with both, and the number of shards."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 16).alias("b")).first()["b"] or 0
    shards = max(1, math.ceil(total / SHARD_BYTES))
    return items.distinct().withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))), shards


def sent_shard(items: DataFrame, shard: int) -> Broadcast:
    """The items of one shard (SHARD_BYTES, about) on their way to the tasks."""
    held = [(r["item_id"], normal(r["text"])) for r in items.where(F.col("shard") == shard).collect()]
    return items.sparkSession.sparkContext.broadcast([x for x in held if x[1]])


def matches(texts: DataFrame, sent: Broadcast, share: float) -> DataFrame:
    """MATCH rows of (doc_id, digest, text) with the items sent, and the digest."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(sent.value, share) if sent.value else None
        for batch in batches:
            docs = zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist(), batch.column("text"), strict=True)
            rows = [(doc_id, digest, *found) for doc_id, digest, text in docs for found in searcher.matches(normal(text.as_py()))] if searcher else []
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "digest", "item_id", "start", "end", "distance", "item_chars"])

    return texts.mapInArrow(find, MATCH.replace("item_id", "digest string, item_id", 1))


def all_matches(docs: DataFrame, benchmark: DataFrame, share: float, digest: Column) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), F.col("text").cast("string").alias("text")).where("text is not null")
    items, shards = item_shards(benchmark)
    if shards == 1:
        return matches(texts, sent_shard(items, 0), share)
    parts, items = [], written(items, "items")
    for shard in range(shards):  # one shard at a time is on the driver and with the tasks
        sent = sent_shard(items, shard)
        parts.append(written(matches(texts, sent, share), "matches"))
        sent.destroy()
    return reduce(DataFrame.unionAll, parts)


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """One row per document and benchmark item found in it, for its best occurrence: places in the normalised text, edit distance, item length."""
    return all_matches(docs, benchmark, share, F.lit("")).drop("digest")


def filtered(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """docs without those in which a benchmark item is found. A benchmark of one shard is looked for where the rows are; else rows found are joined by doc_id and digest of the text."""
    items, shards = item_shards(benchmark)
    if shards > 1:
        name, digest = unused(docs, "found_id"), unused(docs, "found_text")
        found = all_matches(docs, benchmark, share, F.md5("text")).select(F.col("doc_id").alias(name), F.col("digest").alias(digest)).distinct()
        same = F.col("doc_id").cast("long").eqNullSafe(F.col(name)) & (F.md5("text") == F.col(digest))
        return docs.join(found, same, "left_anti")
    sent = sent_shard(items, 0)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(sent.value, share) if sent.value else None
        for batch in batches:
            if searcher:
                batch = batch.filter(pa.array([text is None or next(searcher.matches(normal(text)), None) is None for text in batch.column("text").to_pylist()], pa.bool_()))
            yield batch

    return docs.mapInArrow(keep, docs.schema)
