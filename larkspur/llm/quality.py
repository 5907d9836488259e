"""Quality classifier with hierarchical empirical Bayes.

Two classifiers (high quality, toxic) over words, beginnings of words and shapes of a text are fitted on a bounded sample
of labelled rows, whole texts of any length: features are counted and chosen by grouped sums, and only the chosen ones of
each sampled row reach the driver.
Their evidence is then shrunk through the place a document comes from: every host has a Beta prior around the global
rate, every path of a host one around the host's rate, with strengths estimated from the spread of the rates (method of
moments). Rates are soft counts over all documents: grouped sums, combined before the shuffle, so that a host with a
third of all rows is as cheap as any. A sparse host or path stays at the rate above it.

In tables without URLs the host is `source` and the path `lang`.

Edge cases: a null text is empty, in the fit too, and is rejected like other text that is not high quality; null host
or path is a host or path of its own; a label that is null is left out; with no labels, or of one kind only, that
classifier says nothing and rejects none; repeated rows are judged alike, rows with one doc_id by their own texts; an empty table gives an empty result; columns
with other names are kept by filtered() and ignored here.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkspur.llm.common import written

#: Bounds of the fit: labelled rows, hashed features seen, features kept, and the least rows and association of a feature kept.
SAMPLE_ROWS, WIDTH, KEPT, LEAST_ROWS, LEAST_SCORE = 12_000, 1 << 18, 1500, 3, 10.8  # one chance in a thousand
LEAST_STRENGTH, MOST_STRENGTH = 5.0, 10_000.0
#: Lengths of the beginnings of words that are features too.
STEMS = (4, 5)
_WORD = re.compile(r"\w+")
#: Kinds of the characters below 2**16: 1 capital, 2 letter, 4 part of a word, 8 blank.
_KINDS = np.array([c.isupper() + 2 * c.isalpha() + 4 * (c.isalnum() or c == "_") + 8 * c.isspace() for c in map(chr, range(1 << 16))], np.uint8)


def shape_features(text: str, words: list[str]) -> list[str]:
    """Names of the shapes of a text: shares of capitals, marks, digits, distinct words and repeated lines, in steps."""
    n = max(1, len(text))
    raw = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    kinds = _KINDS[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 0xFFFF)]
    capitals, plain = np.count_nonzero(kinds & 1) / n, np.count_nonzero(kinds & 2) / n
    odd = np.concatenate(([False], (kinds & 12) == 0, [False]))
    marks = (np.count_nonzero(odd[1:-1] & (odd[:-2] | odd[2:])) + text.count("|")) / n  # in runs of two or more
    distinct = len(set(raw)) / max(1, len(raw))
    step = lambda x, k: int(x * k)
    return [
        f"#capitals {step(capitals, 8)}",
        f"#marks {min(8, step(marks, 20))}",
        f"#distinct {step(distinct, 8) if len(raw) >= 20 else 'short'}",
        f"#letters {step(plain, 10)}",
        f"#lines {step(len(set(lines)) / len(lines), 8) if len(lines) >= 8 else 'few'}",
        f"#words {min(16, len(raw).bit_length())}",
        "#none" if not words else "#some",
    ]


def feature_ids(text: str) -> np.ndarray:
    """Distinct hashed features of a text."""
    words = _WORD.findall(text.lower())
    distinct = set(words)
    names = {*distinct, *shape_features(text, words), *(w[:n] + "~" for n in STEMS for w in distinct if len(w) > n)}
    return np.array(sorted({crc32(x.encode()) >> 14 for x in names}), np.int64)  # below WIDTH


def chosen(sample: DataFrame, n: int, n1: int) -> np.ndarray:
    """Of (y, features) rows, n in all and n1 of them with y 1: the features most associated with y, ascending."""
    counts = sample.select("y", F.explode("features").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("ones"))
    expected = F.col("c") * n1 / n
    spread = F.greatest(expected * (1 - n1 / n) * (1 - F.col("c") / n), F.lit(1e-9))
    scored = counts.where(F.col("c") >= LEAST_ROWS).withColumn("score", (F.col("ones") - expected) ** 2 / spread).where(F.col("score") > LEAST_SCORE)
    return np.sort(np.array([r["feature"] for r in scored.orderBy(F.desc("score"), "feature").limit(KEPT).collect()], np.int64))


def fitted(kept: np.ndarray, features: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Features kept, their weights and the intercept: ridge-penalised logistic regression on rows of places in kept."""
    y = labels.astype(np.float64)
    n, n1 = len(y), y.sum()
    if not len(kept):
        return kept, np.zeros(0), math.log(n1 / (n - n1))
    x = np.zeros((n, len(kept) + 1), np.float32)
    x[np.repeat(np.arange(n), [len(f) for f in features]), np.concatenate(features)] = 1
    x[:, -1] = 1
    weight = np.zeros(len(kept) + 1)
    weight[-1] = math.log(n1 / (n - n1))
    ridge = np.append(np.full(len(kept), 0.3), 1e-6)
    for _ in range(12):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip((x @ weight.astype(np.float32)).astype(np.float64), -30, 30)))
        gradient = x.T @ (p - y).astype(np.float32) + ridge * weight  # float64 on one side would copy x
        curve = np.diag(ridge)
        for i in range(0, n, 500):  # in parts: a weighted copy of x would be as large as x
            part = x[i : i + 500]
            curve += (part.T * (p[i : i + 500] * (1 - p[i : i + 500]) + 1e-6).astype(np.float32)) @ part
        step = np.linalg.solve(curve.astype(np.float64), gradient)
        weight -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return kept, weight[:-1], float(weight[-1])


def classifiers(docs: DataFrame, labels: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, float] | None]:
    """The two fits, from at most about SAMPLE_ROWS labelled documents (by hash of doc_id)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    share = min(1.0, SAMPLE_ROWS / max(1, known.count()))
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(place < share)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = pa.array([feature_ids(t.as_py()).astype(np.int32) for t in batch.column("text")], pa.list_(pa.int32()))
            yield pa.record_batch([batch.column("quality"), batch.column("toxic"), held], names=["quality", "toxic", "features"])

    rows = written(texts.join(known.where(place < share), "doc_id").select("quality", "toxic", "text").mapInArrow(features, "quality int, toxic int, features array<int>"), "sample")
    return {kind: classifier(rows.where(F.col(kind).isNotNull()).select((F.col(kind) > 0).cast("int").alias("y"), "features")) for kind in ("quality", "toxic")}


def classifier(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, float] | None:
    """The fit of (y, features) rows; None where there are no rows, or y is always the same."""
    size = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("ones")).first()
    if size["ones"] in (0, size["n"]):
        return None
    kept = chosen(sample, size["n"], size["ones"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.flatnonzero(np.isin(kept, np.asarray(f.values), assume_unique=True)).astype(np.int16).tobytes() for f in batch.column("features")]
            yield pa.record_batch([batch.column("y"), pa.array(found, pa.binary())], names=["y", "places"])

    rows = sample.mapInArrow(places, "y int, places binary").collect()  # KEPT * 2 bytes a row at most
    return fitted(kept, [np.frombuffer(bytes(r["places"]), np.int16) for r in rows], np.array([r["y"] for r in rows]))


def evidence(docs: DataFrame, fits: dict, host: str, path: str, rest: Column | None = None) -> DataFrame:
    """Per row of docs: doc_id, host, path, and log odds of quality and toxic from the text alone (null: no classifier). rest: a struct that travels with the row."""
    sent = docs.sparkSession.sparkContext.broadcast(fits)  # KEPT features each
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), *([] if rest is None else [rest.alias("rest")])]
    plain = docs.select(*columns, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    names = [c for c in plain.columns if c != "text"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        weights = {}
        for kind, fit in held.items():
            if fit is not None:
                weights[kind] = np.zeros(WIDTH)
                weights[kind][fit[0]] = fit[1]
        for batch in batches:
            found = [feature_ids(t.as_py()) for t in batch.column("text")]
            got = [pa.array([float(weights[k][f].sum() + held[k][2]) for f in found], pa.float64()) if k in weights else pa.nulls(len(batch), pa.float64()) for k in ("quality", "toxic")]
            yield pa.record_batch([*(batch.column(c) for c in names), *got], names=[*names, "quality", "toxic"])

    return plain.mapInArrow(judge, StructType(plain.select(*names).schema.fields).add("quality", "double").add("toxic", "double"))


def shrunk(seen: DataFrame, kind: str) -> DataFrame:
    """(host, path, lift): log odds of a path's posterior rate less those of the global rate."""
    odds = lambda p: F.log(p / (1 - p))
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col(kind)))))
    paths = written(seen.where(F.col(kind).isNotNull()).groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    rate = min(1 - 1e-6, max(1e-6, (total["s"] or 0) / max(1, total["n"] or 0)))
    above = strength(hosts, F.col("hs") / F.col("hn"), F.col("hn"), F.lit(rate))
    hosts = hosts.withColumn("hrate", (F.col("hs") + above * rate) / (F.col("hn") + above))
    placed = paths.join(hosts.select("host", "hrate"), paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"])
    below = strength(placed, F.col("s") / F.col("n"), F.col("n"), F.col("hrate"))
    posterior = (F.col("s") + below * F.col("hrate")) / (F.col("n") + below)
    posterior = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), posterior))
    return placed.select("host", "path", (odds(posterior) - math.log(rate / (1 - rate))).alias(f"{kind}_lift"))


def strength(groups: DataFrame, rate, n, prior) -> float:
    """Pseudo-counts of a Beta prior whose spread, with the sampling spread of the groups' sizes, is that of their rates."""
    got = groups.agg(F.sum(n * (rate - prior) ** 2).alias("spread"), F.sum(n).alias("n"), F.sum(prior * (1 - prior)).alias("noise"), F.sum(n * prior * (1 - prior)).alias("most")).first()
    if not got["n"]:
        return MOST_STRENGTH
    between = (got["spread"] - got["noise"]) / got["n"]
    most = got["most"] / got["n"]
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, most / between - 1 if between > 1e-9 else MOST_STRENGTH))


def judged(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", rest: Column | None = None) -> DataFrame:
    """Per row of docs: doc_id, host, path, quality and toxic (posterior probabilities), kept; and rest, if given."""
    seen = written(evidence(docs, classifiers(docs, labels), host, path, rest), "evidence")
    out = seen
    for kind in ("quality", "toxic"):
        lift = shrunk(seen, kind).withColumnRenamed("host", "_h").withColumnRenamed("path", "_p")
        out = out.join(lift, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")), "left").drop("_h", "_p")
        logit = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col(kind))) + F.coalesce(f"{kind}_lift", F.lit(0.0))
        out = out.withColumn(kind, F.when(F.col(kind).isNotNull(), 1 / (1 + F.exp(-logit)))).drop(f"{kind}_lift")
    kept = (F.coalesce("quality", F.lit(1.0)) >= 0.5) & (F.coalesce("toxic", F.lit(0.0)) < 0.5)
    return out.withColumn("kept", kept)


def filtered(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """docs without those rejected. Rows travel with their evidence, so nothing is joined back."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return judged(docs, labels, host, path, rest).where("kept").select(*[F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
