"""Language-model scores by context-tree weighting.

A text is its token sequence: words with A-Z lower-cased, one space between them and one end byte. Each byte is eight
binary decisions; for each decision and each context of 0 to DEPTH bytes there is a node with the counts of zeros and
ones in the training texts. A node's Krichevsky-Trofimov estimate is mixed with what its longer contexts predict, by the
weights of context-tree weighting: w(node) = 1/2 KT(node) + 1/2 product of w(children), bottom up over the counts. A
context never seen in training predicts what its parent does. The score is the sum of log10 of the mixture.

The counts are a table, dealt by hash of the two nearest context bytes, or of three where two alone (`e ` in English) would
be more than a task's share; they grow with the corpus and are never broadcast. Which pairs those are is estimated from a
sample; it decides where counts go, not what they are. Nodes of contexts of 0 and 1 bytes meet on the driver (256 * 255 +
255 at most), and those of such pairs (255 each; a pair holds HOT_BYTES of the corpus, so there are few).
Blocks of documents ask for the distinct contexts that they hold, and get their log-probabilities back. Word counts for
the base score take the same way.

Edge cases: a null or empty text, or one without a word, is the end token alone; repeated rows each count and each score;
no training text at all gives every decision 1/2; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import BLOCK_BYTES, Words, block_count, column_bytes, distinct, in_blocks, mixed, runs_of, text_column, written

DEPTH, SPACE, END = 6, 0x20, 0x0A
END_TOKEN = np.uint64(0x9D3F1C0B5A7E2468)
RUN_BYTES, BLOCKS_A_BUCKET, HELD_KEYS = 1_000_000, 2, 1_500_000
#: Occurrences from which on a pair of context bytes is split by a third, and bytes of the sample that tells.
HOT_BYTES, SAMPLE_BYTES = 100_000_000, 32_000_000
MIDDLE = 8  # bits of rows of split pairs: 8 to 15
PARTS = "bucket int, block int, a binary, b binary"


def packed(keys: np.ndarray) -> bytes:
    """Ascending keys as byte planes of their differences, which compress well."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1), dtype=np.uint64)


class Stream:
    """The byte stream of a run of texts: the key of each byte (nearest context byte first, the byte itself last), the bytes of each text; and its tokens."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, depth: int):
        words = Words(data, offsets)
        n = words.n_texts
        # word bytes, and the first byte after each word, which becomes a space (or the text's end byte)
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        space = np.ones(len(data), bool)
        start, end = np.zeros(len(data) + 1, np.int8), words.end[~edge[words.end]]
        start[words.start] += 1
        start[words.end] -= 1
        np.logical_not(np.cumsum(start[:-1], dtype=np.int8), out=space)
        taken = ~space
        taken[end] = True
        held = words.low[taken]
        held[space[taken]] = SPACE
        count = np.concatenate(([0], np.cumsum(taken)))[offsets]
        length = np.diff(count)
        cut = np.zeros(n, bool)  # the last byte taken is no word byte: the end byte comes in its place
        some = length > 0
        cut[some] = space[taken][count[1:][some] - 1]
        length = length - cut + 1
        at = np.concatenate(([0], np.cumsum(length + depth)))  # texts with depth end bytes before each
        out = np.full(at[-1], END, np.uint8)
        out[np.arange(len(held)) + np.repeat(at[:-1] + depth - count[:-1], np.diff(count))] = held
        out[at[1:] - 1] = END
        wide = out.astype(np.uint64)
        key = wide[depth:].copy()
        for back in range(1, depth + 1):
            key |= wide[depth - back : len(wide) - back] << np.uint64(8 * (depth - back + 1))
        inner = np.ones(len(out), bool)
        inner[(at[:-1, None] + np.arange(depth)).reshape(-1)] = False
        self.key = key[inner[depth:]]
        self.length = length
        self.word = np.concatenate((words.hash, np.full(n, END_TOKEN)))
        self.word_text = np.concatenate((words.text, np.arange(n)))


def key_bucket(keys: np.ndarray, depth: int, buckets: int, hot: np.ndarray) -> np.ndarray:
    near = keys >> np.uint64(8 * (depth - 1))
    if len(hot):
        near = np.where(np.isin(near, hot), keys >> np.uint64(8 * (depth - 2)), near)
    return (mixed(near) % np.uint64(buckets)).astype(np.int32)


def hot_pairs(training: DataFrame, total: int, depth: int) -> np.ndarray:
    """Pairs of nearest context bytes that occur more than HOT_BYTES times in about `total` bytes of text, by a sample of SAMPLE_BYTES."""
    if total <= HOT_BYTES or depth < 3:
        return np.zeros(0, np.uint64)
    share = min(1.0, SAMPLE_BYTES / total)
    sample = training.where(F.pmod(F.xxhash64(F.lit("pairs"), "doc_id", F.octet_length("text")), F.lit(1 << 30)) < share * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for i, j in runs_of(offsets, RUN_BYTES):
                keys = Stream(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], depth).key
                total += np.bincount((keys >> np.uint64(8 * (depth - 1))).astype(np.int64), minlength=1 << 16)
        pair = np.flatnonzero(total)
        yield pa.record_batch([pa.array(pair), pa.array(total[pair])], names=["pair", "n"])

    found = sample.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") > share * HOT_BYTES)
    return np.sort(np.array([r["pair"] for r in found.collect()], np.uint64))


def word_bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(words ^ END_TOKEN) % np.uint64(buckets)).astype(np.int32) + np.int32(buckets)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def rows_by_bucket(block: int, bucket: np.ndarray, keys: np.ndarray, counts: np.ndarray | None) -> list[tuple]:
    order = np.lexsort((keys, bucket))
    used, first = np.unique(bucket[order], return_index=True)
    last = np.append(first[1:], len(order))
    return [(int(b), block, packed(keys[order[i:j]]), None if counts is None else counts[order[i:j]].astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()) for b, i, j in zip(used, first, last, strict=True)]


def parts_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "block", "a", "b"])


def counts_of(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


_LOG2 = math.log(2)


def gamma_table(n: int) -> np.ndarray:
    """lgamma(i + 1/2) and lgamma(i + 1) for small i, in rows."""
    i = np.arange(1, n, dtype=np.float64)
    return np.stack([np.concatenate(([0.5 * math.log(math.pi)], 0.5 * math.log(math.pi) + np.cumsum(np.log(i - 0.5)))), np.concatenate(([0.0], np.cumsum(np.log(i))))])


_SMALL = gamma_table(1 << 14)


def log_gamma(x: np.ndarray, half: bool) -> np.ndarray:
    """lgamma(x + 1/2) if half, else lgamma(x + 1), for whole x; Stirling's series above the table."""
    small = x < _SMALL.shape[1]
    out = _SMALL[0 if half else 1][np.where(small, x, 0)]
    if not small.all():
        z = x[~small] + (0.5 if half else 1.0)
        out[~small] = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log2 of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return (log_gamma(zeros, True) + log_gamma(ones, True) - log_gamma(zeros + ones, False) - math.log(math.pi)) / _LOG2


class Nodes:
    """The nodes of one context depth and one bit of the byte: keys (context, higher bits), counts, log2 weight, share of the own estimate."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        own = log_kt(zeros, ones)
        if below is None:
            self.weight, self.own = own, np.ones(len(keys))
        else:
            self.weight = np.logaddexp2(own, below) - 1
            self.own = np.exp2(np.minimum(own - self.weight - 1, 0.0))

    def only(self, here: np.ndarray) -> Nodes:
        """Those nodes of these that a mask names."""
        out = object.__new__(Nodes)
        out.keys, out.zeros, out.ones, out.weight, out.own = (x[here] for x in (self.keys, self.zeros, self.ones, self.weight, self.own))
        return out

    def parents(self) -> np.ndarray:
        """Keys of the nodes of one context byte less."""
        return ((self.keys >> np.uint64(16)) << np.uint64(8)) | (self.keys & np.uint64(255))

    def estimate(self, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
        return (np.where(bit, self.ones[at], self.zeros[at]) + 0.5) / (self.zeros[at] + self.ones[at] + 1.0)


def context_nodes(keys: np.ndarray, counts: np.ndarray, depth: int, least: int, bit: int) -> dict[int, Nodes]:
    """Nodes of one bit at depths least..depth of one bucket, from its ascending keys and their counts. One bit at a time: all eight would be eight times the memory."""
    out: dict[int, Nodes] = {}
    below = None
    for d in range(depth, least - 1, -1):
        # a node at depth d: the d nearest context bytes, then the bits of the byte above `bit`
        context = keys >> np.uint64(8 * (depth - d + 1))
        symbol = keys & np.uint64(255)
        node = (context << np.uint64(8)) | (symbol >> np.uint64(bit + 1))
        one = (symbol >> np.uint64(bit)) & np.uint64(1)
        if d == depth:
            ids, group = group_sorted(node)
        else:
            ids, group = np.unique(node, return_inverse=True)
        total = np.bincount(group, weights=counts, minlength=len(ids)).astype(np.int64)
        ones = np.bincount(group, weights=counts * one.astype(np.int64), minlength=len(ids)).astype(np.int64)
        sums = None
        if below is not None:
            sums = np.bincount(np.searchsorted(ids, below.parents()), weights=below.weight, minlength=len(ids))
        below = out[d] = Nodes(ids, total - ones, ones, sums)
    return out


def group_sorted(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.concatenate(([True], node[1:] != node[:-1])) if len(node) else np.zeros(0, bool)
    return node[new], np.cumsum(new) - 1


def predicted(keys: np.ndarray, counts: np.ndarray, top: dict[tuple[int, int], Nodes], asked: np.ndarray, depth: int, hot: np.ndarray) -> np.ndarray:
    """log10 probability of each asked key's byte in its context, by a bucket's keys and counts and the nodes of depths 0 and 1, and of depth 2 for hot pairs."""
    total = np.zeros(len(asked))
    symbol = asked & np.uint64(255)
    for bit in range(8):
        nodes = context_nodes(keys, counts, depth, 2, bit)
        one = ((symbol >> np.uint64(bit)) & np.uint64(1)).astype(bool)
        chance, seen = np.full(len(asked), 0.5), np.zeros(len(asked), bool)
        if len(hot):
            nodes[2] = nodes[2].only(~np.isin(nodes[2].keys >> np.uint64(8), hot))  # a hot pair's counts are only in part here
        levels = [(d, nodes[d]) for d in range(depth, 1, -1)] + [(d, top[d, bit]) for d in (2, 1, 0) if (d, bit) in top]
        for d, level in levels:
            if not len(level.keys):
                continue
            ask = ((asked >> np.uint64(8 * (depth - d + 1))) << np.uint64(8)) | (symbol >> np.uint64(bit + 1))
            at = np.minimum(np.searchsorted(level.keys, ask), len(level.keys) - 1)
            here = level.keys[at] == ask
            own = level.estimate(at, one)
            chance = np.where(here, np.where(seen, level.own[at] * own + (1 - level.own[at]) * chance, own), chance)
            seen |= here
        total += np.log10(chance)
    return total


def top_nodes(rows: list[tuple[int, int, int, int, float]]) -> dict[tuple[int, int], Nodes]:
    """Depths 2 (hot pairs), 1 and 0 from sums over the depth below: rows (bit, or MIDDLE + bit for hot pairs, key, zeros, ones, sum of weights below)."""
    out = {}
    kinds = (np.uint64, np.int64, np.int64, np.float64)

    def columns(bit: int) -> list[np.ndarray]:
        mine = sorted(r[1:] for r in rows if r[0] == bit)
        return [np.array([r[i] for r in mine], t) for i, t in enumerate(kinds)]

    def grouped(key: np.ndarray, *values: np.ndarray) -> Nodes:
        ids, group = np.unique(key, return_inverse=True)
        return Nodes(ids, *(np.bincount(group, weights=x, minlength=len(ids)).astype(t) for x, t in zip(values, kinds[1:], strict=True)))

    for bit in range(8):
        one = columns(bit)
        middle = columns(MIDDLE + bit)
        if len(middle[0]):
            out[2, bit] = two = Nodes(*middle)
            one = [np.concatenate(x) for x in zip(one, (two.parents(), two.zeros, two.ones, two.weight), strict=True)]
        out[1, bit] = got = grouped(*one)
        out[0, bit] = grouped(got.keys & np.uint64(255), got.zeros, got.ones, got.weight)
    return out


def scores(docs: DataFrame, training: DataFrame, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte; learned from the texts of training."""
    spark = docs.sparkSession
    plain = text_column(docs)
    n = block_count(plain, block_bytes)
    buckets = max(1, math.ceil(n / BLOCKS_A_BUCKET))
    learned = text_column(training)
    hot = hot_pairs(learned, n * block_bytes, depth)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

        def flush() -> pa.RecordBatch:
            rows = []
            for parts, bucket_of in zip(held, (lambda k: key_bucket(k, depth, buckets, hot), lambda k: word_bucket(k, buckets)), strict=True):
                if parts:
                    keys, counts = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                    rows += rows_by_bucket(-1, bucket_of(keys), keys, counts)
                    parts.clear()
            return parts_table(rows).combine_chunks().to_batches()[0] if rows else pa.RecordBatch.from_pylist([], parts_table([]).schema)

        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for i, j in runs_of(offsets, RUN_BYTES):
                stream = Stream(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], depth)
                for parts, keys in zip(held, (stream.key, stream.word), strict=True):
                    parts.append(np.unique(keys, return_counts=True))
                if sum(len(k) for parts in held for k, _ in parts) > 2 * HELD_KEYS:
                    for parts in held:
                        parts[:] = [summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
                    if sum(len(k) for parts in held for k, _ in parts) > HELD_KEYS:
                        yield flush()
        yield flush()

    def merge(rows: pa.Table) -> pa.Table:
        keys = [unpacked(x.as_buffer()) for x in rows.column("a")]
        got = summed(np.concatenate(keys), np.concatenate([counts_of(x.as_buffer()) for x in rows.column("b")]))
        return parts_table([(rows.column("bucket")[0].as_py(), -1, packed(got[0]), got[1].astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())])

    counted = learned.mapInArrow(count, PARTS)
    model = written(counted.groupBy("bucket").applyInArrow(merge, PARTS), "counts")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over depth 2 for the nodes of depth 1; for words, number and total (bit -1)."""
        for batch in batches:
            for bucket, a, b in zip(batch.column("bucket").to_pylist(), batch.column("a"), batch.column("b"), strict=True):
                keys, counts = unpacked(a.as_buffer()), counts_of(b.as_buffer())
                if bucket >= buckets:
                    yield root_batch([-1], [0], [len(keys)], [int(counts.sum())], [0.0])
                    continue
                for bit in range(8):
                    nodes = context_nodes(keys, counts, depth, 2, bit)
                    parts = [(bit, nodes[2])]
                    if len(hot):
                        parts = [(bit, nodes[2].only(~np.isin(nodes[2].keys >> np.uint64(8), hot))), (MIDDLE + bit, nodes[3].only(np.isin(nodes[3].parents() >> np.uint64(8), hot)))]
                    for kind, level in parts:
                        ids, group = np.unique(level.parents(), return_inverse=True)
                        yield root_batch(np.full(len(ids), kind), ids.astype(np.int64), *(np.bincount(group, weights=x, minlength=len(ids)) for x in (level.zeros, level.ones, level.weight)))

    def root_batch(bit, key, zeros, ones, below) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.asarray(x).astype(t)) for x, t in ((bit, np.int32), (key, np.int64), (zeros, np.int64), (ones, np.int64), (below, np.float64))], names=["bit", "key", "zeros", "ones", "below"])

    sums = model.mapInArrow(roots, "bit int, key long, zeros long, ones long, below double").groupBy("bit", "key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).collect()  # 65,280 rows at most, and 255 for each hot pair
    vocabulary, tokens = next(((r["zeros"], r["ones"]) for r in sums if r["bit"] == -1), (0, 0))
    top = spark.sparkContext.broadcast(top_nodes([tuple(r) for r in sums if r["bit"] >= 0]))

    blocked = in_blocks(plain, n)

    def requests(rows: pa.Table) -> pa.Table:
        keys, words, _ = distinct_keys(rows, depth)
        block = rows.column("block")[0].as_py()
        return parts_table(rows_by_bucket(block, key_bucket(keys, depth, buckets, hot), keys, None) + rows_by_bucket(block, word_bucket(words, buckets), words, None))

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return parts_table([])
        bucket = asked.column("bucket")[0].as_py()
        asks = [unpacked(x.as_buffer()) for x in asked.column("a")]
        keys, counts = (unpacked(known.column("a")[0].as_buffer()), counts_of(known.column("b")[0].as_buffer())) if known.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        wanted = distinct(np.concatenate(asks))
        if bucket >= buckets:
            at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            values = np.where(keys[at] == wanted, counts[at], 0).astype(np.float64) if len(keys) else np.zeros(len(wanted))
        else:
            values = predicted(keys, counts, top.value, wanted, depth, hot).astype(np.float32)
        return parts_table([(bucket, block, values[np.searchsorted(wanted, ask)].tobytes(), None) for block, ask in zip(asked.column("block").to_pylist(), asks, strict=True)])

    base = math.log10(tokens + vocabulary + 1)  # N + 1 * (V + 1)

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        keys, words, streams = distinct_keys(rows, depth)
        got = dict(zip(answers.column("bucket").to_pylist(), answers.column("a"), strict=True))
        values = []
        for asked, bucket, kind in ((keys, key_bucket(keys, depth, buckets, hot), np.float32), (words, word_bucket(words, buckets), np.float64)):
            order = np.lexsort((asked, bucket))
            parts = [np.frombuffer(got[b].as_buffer(), kind) for b in np.unique(bucket).tolist()]
            out = np.empty(len(asked))
            out[order] = np.concatenate(parts) if parts else np.zeros(0)
            values.append(out)
        columns = []
        for stream, m in streams():
            text = np.repeat(np.arange(m, dtype=np.int32), stream.length)
            add = lambda which, w=None, m=m: np.bincount(which, weights=w, minlength=m)
            order = np.argsort(stream.key)
            per_byte = values[0][np.searchsorted(keys, stream.key[order])]
            place = np.argsort(stream.word)
            c, of = values[1][np.searchsorted(words, stream.word[place])], stream.word_text[place]
            columns.append([add(of), add(of, c > 0), add(of, np.log10(c + 1) - base), add(text[order], per_byte), stream.length])
        n_tokens, n_known, base_score, total, length = (np.concatenate(x) for x in zip(*columns, strict=True))
        return pa.table({"doc_id": rows.column("doc_id"), "n_tokens": n_tokens.astype(np.int64), "n_known": n_known.astype(np.int64), "train_tokens": np.full(len(total), tokens), "base_score": base_score, "score": total, "bits_per_byte": -total / math.log10(2) / length})

    by_block = blocked.groupBy("block")
    asked = by_block.applyInArrow(requests, PARTS)
    answers = asked.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(answer, PARTS)
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def distinct_keys(rows: pa.Table, depth: int):
    """The distinct keys and words of a block, and its runs of texts again."""
    data, offsets = column_bytes(rows.column("text"))

    def streams():
        for i, j in runs_of(offsets, RUN_BYTES):
            yield Stream(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], depth), j - i

    keys, words = [], []
    for stream, _ in streams():
        keys.append(distinct(stream.key))
        words.append(distinct(stream.word))
    merged = lambda parts: distinct(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    return merged(keys), merged(words), streams


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: learned from documents outside the held-out seventh."""
    remainder = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)), F.lit(0))
    got = scores(docs, docs.where(remainder != 2))
    return got.withColumn("held_out", remainder == 2).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
