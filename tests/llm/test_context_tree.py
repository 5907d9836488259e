"""Context-tree weighting against the recursion written out, and the base score against counts."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from larkspur.llm import context_tree

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def stream(text):
    return " ".join(tokens(text)).encode() + b"\n"


def log_kt(a, b):
    return (math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)) / math.log(2)


class Tree:
    """Counts of each (context, bits so far); weights by the recursion over contexts one byte longer."""

    def __init__(self, texts, depth):
        self.depth, self.counts = depth, defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for t in texts:
            data = b"\n" * depth + stream(t)
            for i in range(depth, len(data)):
                context, bits = data[i - depth : i][::-1], 1
                for k in range(7, -1, -1):
                    bit = data[i] >> k & 1
                    for d in range(depth + 1):
                        self.counts[context[:d], bits][bit] += 1
                        if d:
                            self.children[context[: d - 1], bits].add(context[:d])
                    bits = bits * 2 + bit
        self.known = {}

    def weight(self, context, bits):
        if (context, bits) not in self.known:
            own = log_kt(*self.counts[context, bits])
            if len(context) == self.depth:
                self.known[context, bits] = own
            else:
                below = sum(self.weight(c, bits) for c in self.children[context, bits])
                top = max(own, below)
                self.known[context, bits] = top + math.log2(2 ** (own - top) + 2 ** (below - top)) - 1
        return self.known[context, bits]

    def chance(self, context, bits, bit, d=0):
        """Of the next bit: a context's own estimate and what the longer one says, by their share of the weight; unseen longer ones say the same as this."""
        if (context[:d], bits) not in self.counts:
            return None
        a = self.counts[context[:d], bits]
        own = (a[bit] + 0.5) / (sum(a) + 1)
        if d == self.depth:
            return own
        longer = self.chance(context, bits, bit, d + 1)
        if longer is None:
            return own
        share = 2 ** min(0.0, log_kt(*a) - 1 - self.weight(context[:d], bits))
        return share * own + (1 - share) * longer

    def score(self, text):
        data, total = b"\n" * self.depth + stream(text), 0.0
        for i in range(self.depth, len(data)):
            context, bits = data[i - self.depth : i][::-1], 1
            for k in range(7, -1, -1):
                bit = data[i] >> k & 1
                p = self.chance(context, bits, bit)
                total += math.log10(0.5 if p is None else p)
                bits = bits * 2 + bit
        return total


@pytest.mark.parametrize(("depth", "hot"), [(2, 10**8), (4, 10**8), (6, 10**8), (6, 2), (3, 4)])
def test_against_the_recursion(spark, monkeypatch, depth, hot):
    """hot: occurrences from which pairs of context bytes are split by a third."""
    monkeypatch.setattr(context_tree, "HOT_BYTES", hot)
    training = ["The cat sat on the mat", "the cat ate", "a dog sat", "", None, "Été été"]
    docs = {i: t for i, t in enumerate([*training, "the cat sat", "zebra quiz", "the the the the", "x"])}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in context_tree.scores(df, df.where("doc_id < 6"), depth, block_bytes=40).collect()}
    pairs = context_tree.hot_pairs(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), 1000, depth)
    assert (len(pairs) > 0) == (hot < 10)
    tree = Tree(training, depth)
    counts = Counter(w for t in training for w in [*tokens(t), None])
    n, v = sum(counts.values()), len(counts)
    for d, t in docs.items():
        own = [*tokens(t), None]
        assert got[d]["score"] == pytest.approx(tree.score(t), rel=1e-5, abs=1e-5)
        assert (got[d]["n_tokens"], got[d]["n_known"], got[d]["train_tokens"]) == (len(own), sum(w in counts for w in own), n)
        assert got[d]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))


def test_probabilities_sum_to_one(spark, prose):
    """Of all bytes after one context."""
    import numpy as np

    keys, counts = np.unique(context_tree.Stream(np.frombuffer(prose(300, 1).encode(), np.uint8), np.array([0, len(prose(300, 1).encode())]), 6).key, return_counts=True)
    rows = []
    for bit in range(8):
        level = context_tree.context_nodes(keys, counts, 6, 2, bit)[2]
        ids, group = np.unique(((level.keys >> np.uint64(16)) << np.uint64(8)) | (level.keys & np.uint64(255)), return_inverse=True)
        rows += [(bit, int(i), int(z), int(o), float(w)) for i, z, o, w in zip(ids, *(np.bincount(group, weights=x) for x in (level.zeros, level.ones, level.weight)), strict=True)]
    context = keys[len(keys) // 2] & ~np.uint64(255)
    asked = np.sort(context | np.arange(256, dtype=np.uint64))
    assert (10 ** context_tree.predicted(keys, counts, context_tree.top_nodes(rows), asked, 6, np.zeros(0, np.uint64))).sum() == pytest.approx(1)


def test_odd_rows(odd, empty):
    got = {}
    for r in context_tree.digest(odd).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == 13 and got[3][0]["n_tokens"] == 1 and got[5][0]["n_tokens"] == 1
    assert got[1][0]["score"] == got[1][1]["score"] < 0
    assert context_tree.digest(empty).count() == 0


def test_no_training_text(spark):
    df = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    got = context_tree.scores(df, df.limit(0)).first()
    assert got["score"] == pytest.approx(24 * math.log10(0.5)) and got["train_tokens"] == 0
