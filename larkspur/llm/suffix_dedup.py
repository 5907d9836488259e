"""Exact substring de-duplication over merged Burrows-Wheeler transforms.

A byte is removed if a string of ``least`` bytes that covers it also starts in a document with a smaller doc_id.

1. Each window of ``least`` bytes has an anchor: the least hash of its ``anchor``-byte strings. Equal windows have equal
   anchors, so only runs of windows whose anchor occurs in two documents can hold a repeat (found by a shuffle of anchor
   hashes, one per block of documents).
2. A run's whole string (a segment) that occurs in several documents is settled at once: all but the first lose it.
3. Different segments with the same anchor are compared byte by byte: shards of them get a Burrows-Wheeler transform
   each, and the transforms are merged by refining their interleave ``least`` times. After round h the interleave is
   sorted by the first h bytes and has a border where a common prefix is shorter than h; the round in which a border
   comes gives the common prefix of the suffixes beside it. After the last round the stretches whose common prefixes
   reach ``least`` are the repeated intervals. Suffixes are sorted once, within their shard, and never again.
4. The windows found are sent back to their blocks of documents, which remove the bytes.

No group grows with a hot text: a block sends one entry per distinct segment, however many of its documents hold it.

Edge cases: null text is empty; texts below ``least`` bytes are kept; whole copies lose everything to the smallest
doc_id; rows with equal doc_id never remove each other's bytes; a row without doc_id removes nothing and loses nothing; an empty table gives an empty result; other columns are
ignored here and kept by filtered().
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh3_64_intdigest

from larkspur.llm.common import BLOCK_BYTES, block_count, blobs, column_bytes, gram_hashes, in_blocks, long_column, mixed, runs_of, text_column, window_minima, written

LEAST, ANCHOR, SHARDS, RUN_BYTES = 50, 20, 4, 1_000_000
#: Blocks whose anchors meet in one bucket of the shuffle.
BLOCKS_A_BUCKET = 2
MESSAGE = "block int, kind int, a binary, b binary"
RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


class Block:
    """The documents of one block, in the order of (doc_id, text), and their window runs: document, first window, windows, anchor and segment hash."""

    def __init__(self, docs: pa.Table, copies: np.ndarray, least: int, anchor: int, only: np.ndarray | None = None):
        docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids, self.rest = long_column(docs.column("doc_id")), docs.column("rest") if "rest" in docs.column_names else None
        self.data, self.offsets = column_bytes(docs.column("text"))
        self.copy = np.isin(self.ids, copies)
        parts = []
        for i, j in runs_of(self.offsets, RUN_BYTES):
            got = window_runs(self.data[self.offsets[i] : self.offsets[j]], self.offsets[i : j + 1] - self.offsets[i], self.copy[i:j], least, anchor, only)
            parts.append((got[0] + i, got[1] + self.offsets[i], *got[2:]))
        self.doc, self.first, self.windows, self.anchor, self.segment = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2

    def by_segment(self) -> tuple[np.ndarray, np.ndarray]:
        """Runs in the order of (anchor, segment, document), and where each segment's runs begin."""
        order = np.lexsort((self.doc, self.segment, self.anchor))
        a, s = self.anchor[order], self.segment[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
        return order, np.flatnonzero(new)


def window_runs(data: np.ndarray, offsets: np.ndarray, skip: np.ndarray, least: int, anchor: int, only: np.ndarray | None):
    """Maximal runs of windows of one document with one anchor."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if len(data) < least:
        return none
    low = window_minima(mixed(gram_hashes(data, anchor)), least - anchor + 1)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(low)]
    fits = (np.arange(len(low)) + least <= offsets[doc + 1]) & ~skip[doc]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | (fits[1:] != fits[:-1])
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(low)))
    use = fits[first]
    if only is not None:
        at = np.minimum(np.searchsorted(only, low[first]), max(0, len(only) - 1))
        use &= (only[at] == low[first]) if len(only) else False
    first, windows = first[use], windows[use]
    if not len(first):
        return none
    if only is None:  # anchors alone are asked for
        return doc[first], first, windows, low[first], np.zeros(len(first), np.uint64)
    view = memoryview(np.ascontiguousarray(data))
    ends = (first + windows + least - 1).tolist()
    segment = np.fromiter((xxh3_64_intdigest(view[i:j]) for i, j in zip(first.tolist(), ends, strict=True)), np.uint64, len(first))
    return doc[first], first, windows, low[first], segment


def unpack(column, kind) -> np.ndarray:
    """The values of all blobs of a column, end to end."""
    return column_bytes(column)[0].view(kind) if len(column) else np.zeros(0, kind)


def message_parts(messages: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's messages: doc_ids of copies, repeated anchors (sorted), and window runs found (rows of anchor, segment, first, windows)."""
    kinds = long_column(messages.column("kind"))
    copies, anchors, found = (messages.filter(pa.array(kinds == k)) for k in (0, 1, 2))
    runs = np.stack([unpack(found.column("a"), np.uint64).reshape(-1, 2)[:, i] for i in (0, 1)] + [unpack(found.column("b"), np.int32).reshape(-1, 2)[:, i].astype(np.uint64) for i in (0, 1)], axis=1) if found.num_rows else np.zeros((0, 4), np.uint64)
    return unpack(copies.column("a"), np.int64), np.unique(unpack(anchors.column("a"), np.uint64)), runs


def duplicate_bytes(docs: DataFrame, least: int = LEAST, anchor: int = ANCHOR, block_bytes: int = BLOCK_BYTES, whole_characters: bool = False, rest: Column | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, the removed spans (byte offsets) and the bytes kept. whole_characters: one that loses a byte goes whole. rest: a struct that travels with the row."""
    plain = text_column(docs if rest is None else docs.select("doc_id", "text", rest.alias("rest")), *([] if rest is None else ["rest"]))
    nameless, plain = plain.where("doc_id is null"), plain.where("doc_id is not null")
    n = block_count(plain, block_bytes)
    buckets = max(1, math.ceil(n / BLOCKS_A_BUCKET))
    blocked = in_blocks(plain, n)
    result = StructType.fromDDL(RESULT)
    if rest is not None:
        result = result.add(plain.schema["rest"])

    # Whole copies, found by text digest, need no comparison: only their ids travel.
    ids = blocked.select("block", "doc_id", F.md5("text").alias("digest")).where(F.octet_length("text") >= least)
    firsts = ids.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    later = ids.join(firsts, "digest").where(F.col("doc_id") > F.col("first_id"))
    copies = written(later.select("block", "doc_id").distinct(), "copies")
    copy_messages = copies.select("block", F.lit(0).alias("kind"), little_endian("doc_id").alias("a"), F.lit(None).cast("binary").alias("b"))

    def anchors(docs: pa.Table, messages: pa.Table) -> pa.Table:
        block = block_of(docs, messages)
        held = Block(docs, message_parts(messages)[0], least, anchor)
        order = np.lexsort((held.doc, held.anchor))
        a, d = held.anchor[order], held.doc[order]
        first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, int)
        several = np.maximum.reduceat(d, first) != np.minimum.reduceat(d, first) if len(a) else np.zeros(0, bool)
        return dealt(a[first], block, buckets, [a[first], several.astype(np.uint8)])

    def repeated(rows: pa.Table) -> pa.Table:
        counts = column_bytes(rows.column("b"))[1]
        a, several = unpack(rows.column("a"), np.uint64), unpack(rows.column("b"), np.uint8)
        source = np.repeat(np.arange(rows.num_rows), np.diff(counts))
        order = np.argsort(a, kind="stable")
        a, several, source = a[order], several[order], source[order]
        first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        size = np.diff(np.append(first, len(a)))
        hit = np.repeat((size > 1) | (np.maximum.reduceat(several, first) > 0), size)
        a, source = a[hit], source[hit]
        order = np.argsort(source, kind="stable")
        bounds = np.searchsorted(source[order], np.arange(rows.num_rows + 1))
        return messages_of(rows.column("block"), 1, blobs(a[order], bounds))

    def segments(docs: pa.Table, messages: pa.Table) -> pa.Table:
        block = block_of(docs, messages)
        copies, only, _ = message_parts(messages)
        held = Block(docs, copies, least, anchor, only)
        order, first = held.by_segment()
        lead = order[first]  # the first document's run stands for the block's others
        lengths = held.windows[lead] + least - 1
        return dealt(held.anchor[lead], block, buckets, [np.stack([held.anchor[lead], held.segment[lead]], axis=1), np.stack([held.ids[held.doc[lead]], lengths], axis=1)], (held.data, held.first[lead], lengths))

    def compared(rows: pa.Table) -> pa.Table:
        keys = unpack(rows.column("a"), np.uint64).reshape(-1, 2)
        facts = unpack(rows.column("b"), np.int64).reshape(-1, 2)
        data = column_bytes(rows.column("c"))[0]
        source = np.repeat(np.arange(rows.num_rows), np.diff(column_bytes(rows.column("b"))[1]) // 16)
        found = repeated_windows(keys, facts[:, 0], facts[:, 1], data, least, anchor)
        which = source[found[:, 0]]
        order = np.argsort(which, kind="stable")
        found, which = found[order], which[order]
        bounds = np.searchsorted(which, np.arange(rows.num_rows + 1))
        return messages_of(rows.column("block"), 2, blobs(keys[found[:, 0]], bounds), blobs(found[:, 1:].astype(np.int32), bounds))

    def removed(docs: pa.Table, messages: pa.Table) -> pa.Table:
        copies, only, runs = message_parts(messages)
        return without(Block(docs, copies, least, anchor, only), runs, least, whole_characters)

    by_block = blocked.groupBy("block")
    dealt_schema = "bucket int, block int, a binary, b binary, c binary"
    sent = by_block.cogroup(copy_messages.groupBy("block")).applyInArrow(anchors, dealt_schema)
    repeats = sent.groupBy("bucket").applyInArrow(repeated, MESSAGE)
    known = copy_messages.unionByName(repeats)
    candidates = by_block.cogroup(known.groupBy("block")).applyInArrow(segments, dealt_schema)
    found = candidates.groupBy("bucket").applyInArrow(compared, MESSAGE)
    left = by_block.cogroup(known.unionByName(found).groupBy("block")).applyInArrow(removed, result)
    size = F.octet_length("text").cast("long")
    whole = nameless.select("doc_id", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"), F.encode("text", "UTF-8").alias("kept"), *result.names[5:])
    return left.unionByName(whole)


def little_endian(column: str):
    """A long as 8 bytes in the order numpy reads."""
    return F.unhex(F.regexp_replace(F.lpad(F.hex(F.col(column)), 16, "0"), "(..)(..)(..)(..)(..)(..)(..)(..)", "$8$7$6$5$4$3$2$1"))


def block_of(docs: pa.Table, messages: pa.Table) -> int:
    return (docs if docs.num_rows else messages).column("block")[0].as_py()


def messages_of(block, kind: int, a: pa.Array, b: pa.Array | None = None) -> pa.Table:
    table = pa.table({"block": block, "kind": pa.array(np.full(len(a), kind, np.int32)), "a": a, "b": b if b is not None else pa.nulls(len(a), pa.binary())})
    return table.filter(pc.greater(pc.binary_length(table.column("a")), 0))


def dealt(hashes: np.ndarray, block: int, buckets: int, columns: list[np.ndarray], texts=None) -> pa.Table:
    """Rows for the buckets of hashes: the entries of each, packed."""
    bucket = (mixed(hashes) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    used, first = np.unique(bucket[order], return_index=True)
    bounds = np.append(first, len(order))
    c = pa.nulls(len(used), pa.binary())
    if texts is not None:
        data, at, lengths = texts
        at, lengths = at[order], lengths[order]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        c = blobs(data[np.arange(ends[-1]) + np.repeat(at - ends[:-1], lengths)], ends[bounds])
    return pa.table({"bucket": pa.array(used), "block": pa.array(np.full(len(used), block, np.int32)), "a": blobs(columns[0][order], bounds), "b": blobs(columns[1][order], bounds), "c": c})


def without(held: Block, runs: np.ndarray, least: int, whole_characters: bool) -> pa.Table:
    """A block's result: the windows of later documents of the block, and of the runs found elsewhere, taken out."""
    n = len(held.data)
    change = np.zeros(n + 1, np.int32)
    order, first = held.by_segment()
    if len(order):
        size = np.diff(np.append(first, len(order)))
        lead_id = np.repeat(held.ids[held.doc[order[first]]], size)
        lost = order[held.ids[held.doc[order]] > lead_id]
        np.add.at(change, held.first[lost], 1)
        np.add.at(change, held.first[lost] + held.windows[lost] + least - 1, -1)
        if len(runs):
            pair = np.dtype([("a", np.uint64), ("s", np.uint64)])
            have = np.rec.fromarrays([held.anchor[order[first]], held.segment[order[first]]], dtype=pair)
            ask = np.rec.fromarrays([runs[:, 0], runs[:, 1]], dtype=pair)
            group = np.searchsorted(have, ask)
            times = size[group]
            row = order[np.repeat(first[group], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            run = np.repeat(np.arange(len(runs)), times)
            same = held.ids[held.doc[row]] == np.repeat(held.ids[held.doc[order[first[group]]]], times)
            row, run = row[same], run[same]
            start = held.first[row] + runs[run, 2].astype(np.int64)
            np.add.at(change, start, 1)
            np.add.at(change, start + runs[run, 3].astype(np.int64) + least - 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    lengths = np.diff(held.offsets)
    gone |= np.repeat(held.copy & (lengths >= least), lengths)
    if whole_characters and n:
        lead = np.flatnonzero((held.data & 0xC0) != 0x80)
        gone = np.repeat(np.logical_or.reduceat(gone, lead), np.diff(np.append(lead, n)))
    edge = np.zeros(n + 1, bool)
    edge[held.offsets] = True
    starts = np.flatnonzero(gone & (edge[:-1] | np.concatenate(([True], ~gone[:-1])))) if n else np.zeros(0, int)
    ends = np.flatnonzero(gone & (edge[1:] | np.concatenate((~gone[1:], [True])))) + 1 if n else np.zeros(0, int)
    owner = np.searchsorted(held.offsets, starts, side="right") - 1
    counts = np.concatenate(([0], np.cumsum(gone)))
    lost_bytes = counts[held.offsets[1:]] - counts[held.offsets[:-1]]
    kept = held.data[~gone]
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(lengths) + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(starts - held.offsets[owner], pa.int64()), pa.array(ends - held.offsets[owner], pa.int64())], ["start", "end"]))
    ids = pa.array(held.ids, mask=held.ids == np.iinfo(np.int64).min)
    columns = {"doc_id": ids, "n_bytes": pa.array(lengths), "n_removed": pa.array(lost_bytes), "spans": spans, "kept": blobs(kept, np.concatenate(([0], np.cumsum(lengths - lost_bytes))))}
    return pa.table(columns if held.rest is None else columns | {"rest": held.rest})


def repeated_windows(keys: np.ndarray, doc: np.ndarray, length: np.ndarray, data: np.ndarray, least: int, anchor: int) -> np.ndarray:
    """Rows (entry, first window, windows) of the windows that also start in a smaller document. keys: anchor and segment hash of each entry."""
    begin = np.concatenate(([0], np.cumsum(length)))[:-1]
    order = np.lexsort((doc, keys[:, 1], keys[:, 0]))
    k = keys[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    lead = order[first]
    later = order[doc[order] > doc[lead][group]]
    whole = np.stack([later, np.zeros(len(later), np.int64), length[later] - least + 1], axis=1)

    # Of segments with one anchor, those that share 15 more bytes on either side of it may share a window.
    a = keys[lead, 0]
    anew = np.concatenate(([True], a[1:] != a[:-1])) if len(a) else np.zeros(0, bool)
    agroup = np.cumsum(anew) - 1
    asize = np.bincount(agroup) if len(a) else np.zeros(0, int)
    lead = lead[(asize > 1)[agroup]] if len(a) else lead
    if not len(lead):
        return whole
    agroup = agroup[(asize > 1)[agroup]]
    lead = near_enough(lead, agroup, keys, begin, length, data, least, anchor)
    parts, i = [whole], 0
    sizes = np.cumsum(length[lead])
    anchors = keys[lead, 0]
    border = np.flatnonzero(np.concatenate((anchors[1:] != anchors[:-1], [True]))) + 1 if len(lead) else []
    for j in border:  # whole anchor groups, RUN_BYTES together
        if sizes[j - 1] - (sizes[i - 1] if i else 0) >= RUN_BYTES or j == len(lead):
            part = lead[i:j]
            got = merged_transforms([data[b : b + n] for b, n in zip(begin[part], length[part], strict=True)], doc[part], least)
            parts.append(np.stack([part[got[:, 0]], got[:, 1], got[:, 2]], axis=1))
            i = j
    return np.concatenate(parts)


def near_enough(lead, agroup, keys, begin, length, data, least, anchor) -> np.ndarray:
    """The entries that share the anchor with half of the rest of a window before or after it, and all those where an anchor occurs twice in a segment."""
    half = (least - anchor) // 2
    reach = anchor + half
    ends = np.concatenate(([0], np.cumsum(length[lead])))
    joined = data[np.arange(ends[-1]) + np.repeat(begin[lead] - ends[:-1], length[lead])]
    entry = np.repeat(np.arange(len(lead)), length[lead])
    h = mixed(gram_hashes(joined, anchor))
    place = np.arange(len(h))
    hit = np.flatnonzero((h == keys[lead, 0][entry[: len(h)]]) & (place + anchor <= ends[1:][entry[: len(h)]]))
    times = np.bincount(entry[hit], minlength=len(lead))
    odd = np.bincount(agroup, weights=times != 1)[agroup] > 0 if agroup[0] == 0 else np.isin(agroup, agroup[times != 1])
    wide = mixed(gram_hashes(joined, reach))
    shared = odd.copy()
    one = hit[times[entry[hit]] == 1]
    for at in (one - half, one):
        ok = (at >= ends[:-1][entry[one]]) & (at + reach <= ends[1:][entry[one]])
        e, value = entry[one][ok], wide[at[ok]]
        if len(e):
            order = np.lexsort((value, agroup[e]))
            same = (value[order][1:] == value[order][:-1]) & (agroup[e][order][1:] == agroup[e][order][:-1])
            shared[e[order][1:][same]] = True
            shared[e[order][:-1][same]] = True
    return lead[shared]


_MASKS = np.array([0] + [(2**64 - 1) ^ (2 ** (64 - 8 * v) - 1) for v in range(1, 9)], dtype=np.uint64)


class Shard:
    """The sorted suffixes of some strings (by their first `least` bytes) and their Burrows-Wheeler transform; 0 ends a string."""

    def __init__(self, strings: list[np.ndarray], numbers: np.ndarray, least: int):
        lengths = np.array([len(s) + 1 for s in strings])
        ends = np.cumsum(lengths)
        text = np.zeros(ends[-1], np.uint8)
        body = np.ones(len(text), bool)
        body[ends - 1] = False
        text[body] = np.concatenate(strings) + np.uint8(1)  # 0xFF is no byte of UTF-8
        string = np.repeat(np.arange(len(strings)), lengths)
        rest = ends[string] - np.arange(len(text))
        words = -(-least // 8)
        padded = np.concatenate((text, np.zeros(8 * words + 8, np.uint8)))
        eight = np.zeros(len(text) + 8 * words, np.uint64)
        for i in range(8):
            eight = (eight << np.uint64(8)) | padded[i : i + len(eight)]
        keys = [eight[8 * j : 8 * j + len(text)] & _MASKS[np.clip(rest - 8 * j, 0, 8)] for j in range(words)]
        self.suffix = np.lexsort(keys[::-1])
        self.transform = np.where(self.suffix > 0, text[self.suffix - 1], 0).astype(np.uint8)
        self.number, self.offset, self.rest = numbers[string[self.suffix]], (lengths[string] - rest)[self.suffix], rest[self.suffix] - 1


def merged_transforms(strings: list[np.ndarray], doc: np.ndarray, least: int, shards: int = SHARDS) -> np.ndarray:
    """Rows (string, first window, windows): windows of `least` bytes whose interval of the merged transforms holds a smaller document."""
    held = [Shard([strings[i] for i in range(s, len(strings), shards)], np.arange(s, len(strings), shards), least) for s in range(min(shards, len(strings)))]
    source = np.repeat(np.arange(len(held), dtype=np.uint8), [len(s.suffix) for s in held])
    block = np.zeros(len(source), np.int32)
    symbol = np.empty(len(source), np.uint8)
    common = np.full(len(source), least, np.min_scalar_type(least))  # bytes in common with the suffix before, up to `least`: the round before its border came
    common[:1] = 0
    for done in range(least):
        for s, shard in enumerate(held):
            symbol[source == s] = shard.transform
        order = np.argsort(symbol, kind="stable")
        source, sym, b = source[order], symbol[order], block[order]
        new = (sym[1:] != sym[:-1]) | ((b[1:] != b[:-1]) & (sym[1:] > 0))  # what follows a string's end counts for nothing
        common[1:][new & (common[1:] > done)] = done
        block = np.zeros(len(source), np.int32)
        np.cumsum(new, out=block[1:])
    number, offset, rest = (np.empty(len(source), np.int64) for _ in range(3))
    for s, shard in enumerate(held):
        at = source == s
        number[at], offset[at], rest[at] = shard.number, shard.offset, shard.rest
    whole = rest >= least
    own = np.where(whole, doc[number], np.iinfo(np.int64).max)
    interval = np.flatnonzero(common < least)  # a repeated interval lasts while common prefixes reach `least`
    least_doc = np.minimum.reduceat(own, interval)
    hit = whole & (np.repeat(least_doc, np.diff(np.append(interval, len(own)))) < own)
    number, offset = number[hit], offset[hit]
    order = np.lexsort((offset, number))
    number, offset = number[order], offset[order]
    new = np.concatenate(([True], (number[1:] != number[:-1]) | (offset[1:] != offset[:-1] + 1))) if len(order) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return np.stack([number[first], offset[first], np.diff(np.append(first, len(order)))], axis=1)


def filtered(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with the repeated bytes taken out of text (a character that loses a byte goes whole); documents that lose their last word go. Other columns travel with the text, so nothing is joined back."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rest = F.struct(F.col("text").isNull().alias("none"), F.struct(*others).alias("columns"))
    found = duplicate_bytes(docs, least, whole_characters=True, rest=rest)
    text = F.when(~F.col("rest.none"), F.col("kept").cast("string"))
    left = found.where((F.col("n_removed") == 0) | text.rlike(r"[^\x20\x09-\x0D]"))
    return left.select(*[(text if c == "text" else F.col(f"rest.columns.`{c}`")).alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: sizes, number of spans and the hash of the bytes kept."""
    return duplicate_bytes(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The query's result by all windows of 50 bytes, as hexadecimal text.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
  p AS (SELECT doc_id, n, k, substr(h, 2000 * k + 1, 2098) AS p FROM (SELECT *, unnest(range(0, (n + 999) // 1000)) AS k FROM n)),
  w AS (SELECT doc_id, 1000 * k + i AS i, substr(p, 2 * i - 1, 100) AS w FROM (SELECT doc_id, k, p, unnest(range(1, least(1000, n - 1000 * k - 49) + 1)) AS i FROM p)),
  hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS first FROM w) WHERE first < doc_id),
  b AS (SELECT doc_id, 1000 * k + i AS i, substr(p, 2 * i - 1, 2) AS b FROM (SELECT doc_id, k, p, unnest(range(1, least(1000, n - 1000 * k) + 1)) AS i FROM p)),
  c AS (SELECT b.doc_id, b.i, b, coalesce(max(hits.i) OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS UNBOUNDED PRECEDING) + 50 > b.i, false) AS gone FROM b LEFT JOIN hits ON hits.doc_id = b.doc_id AND hits.i = b.i),
  r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS start FROM c),
  g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (start) AS n_spans, coalesce(string_agg(b, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, CASE WHEN d.doc_id IS NULL THEN h ELSE '' END))) AS kept_sha256 FROM n d LEFT JOIN g ON g.doc_id = d.doc_id
"""
