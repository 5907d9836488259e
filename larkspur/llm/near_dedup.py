"""MinHash near-duplicate groups over SetSketch registers.

Each document's set of word shingles gets registers: truncated minima of exponential values at exponentially spaced
levels (base BASE, near 1), so that registers of a union are the larger ones and the chance of equal registers is about
the Jaccard similarity. Bands of registers give candidates; the joint likelihood of the counts of larger, smaller and
equal registers, at the known set sizes, drops pairs that cannot reach the threshold; full sets confirm the rest.

Pairs within a group are not listed. Equal sets are one class. Each candidate is checked against the smallest centre (the
least member) of its band buckets, one pair a candidate, and components of confirmed links follow. In buckets that hold
several components yet, members are checked against the centre of the bucket. Buckets that are still open are worked
off whole: those that share members form a cluster, whose members meet all together where it is small or dense, and else
bucket by bucket, each pair in the first bucket it shares. Either way they meet in groups of blocks, each task compares
two blocks of bounded size by their full sets, skips what is already connected, and returns only links that connect
something new. So no link between components is lost, however large the group. The number of bands makes the chance to
miss a pair at the threshold below MISS.

Edge cases: null text and text without a word have an empty set, linked with nothing (component: itself, kept);
texts with fewer words than a shingle are one shingle; repeated rows share a class and a doc_id, and are all kept or all
dropped; of rows with one doc_id and different texts the set of the least digest is compared for all of them; a null doc_id keeps a null component and is kept; an empty table gives an empty result; other columns are
ignored here and kept by filtered().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import Words, column_bytes, long_column, mixed, runs_of, text_column, written
from larkspur.llm.components import component_labels

ROWS, MISS = 4, 1e-7
BASE_LEVEL, RATE = 1.02, 20.0
#: Members of a block, and bytes of their sets, that one task compares with as many again.
BLOCK_MEMBERS, BLOCK_SET_BYTES, MEMBERS_A_GROUP = 1024, 8_000_000, 2000
_SEED = np.random.default_rng(7)
_TIMES = _SEED.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _SEED.integers(0, 2**64, 4096, dtype=np.uint64)
_STEPS = _SEED.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_count(threshold: float, rows: int = ROWS) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**rows))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    words = Words(data, offsets)
    h, b = words.hash, words.bounds
    n = max(0, len(h) - k + 1)
    grams = np.zeros(n, np.uint64)
    for i in range(k):
        grams += h[i : i + n] * _STEPS[i]
    grams = mixed(grams)
    for i in range(words.n_texts):
        count = b[i + 1] - b[i]
        if count >= k:
            yield np.unique(grams[b[i] : b[i + 1] - k + 1])
        elif count:
            yield mixed((h[b[i] : b[i + 1]] * _STEPS[:count]).sum(dtype=np.uint64, keepdims=True) + _STEPS[32 + count])
        else:
            yield np.zeros(0, np.uint64)


def multipliers(m: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of m registers."""
    times, plus = [_TIMES[:m]], [_PLUS[:m]]
    for i in range(1, math.ceil(m / 4096)):
        more = np.random.default_rng((7, i))
        times.append(more.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        plus.append(more.integers(0, 2**64, 4096, dtype=np.uint64))
    return np.concatenate(times)[:m], np.concatenate(plus)[:m]


def registers(grams: np.ndarray, m: int) -> np.ndarray:
    """SetSketch registers of a set of hashes."""
    if not len(grams):
        return np.zeros(m, np.uint16)
    low = np.full(m, 2**64 - 1, np.uint64)
    times, plus = multipliers(m)
    for i in range(0, len(grams), 4096):
        low = np.minimum(low, (grams[i : i + 4096][None, :] * times[:, None] + plus[:, None]).min(axis=1))
    least = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(least, 1e-300)) / math.log(BASE_LEVEL)), 0, 65535).astype(np.uint16)


def likelihoods(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Joint likelihood estimate of the Jaccard similarity, and whether threshold or more is within 25 nats of it."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    best, estimate, high = (np.full(len(u), -np.inf), np.zeros(len(u)), np.full(len(u), -np.inf))
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE_LEVEL - 1) / BASE_LEVEL) / math.log(BASE_LEVEL)
    for share in np.concatenate((np.linspace(0, 1, 26), [np.nan])):
        j = np.minimum(most, threshold) if np.isnan(share) else share * most
        up, down = np.maximum(chance(u - v * j), 1e-12), np.maximum(chance(v - u * j), 1e-12)
        score = larger * np.log(up) + smaller * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-12))
        better = score > best
        best, estimate = np.where(better, score, best), np.where(better, j, estimate)
        high = np.where(j >= threshold - 1e-9, np.maximum(high, score), high)
    return estimate, high >= best - 25


def digest_of(grams: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes."""
    return int(grams.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mixed(grams ^ _STEPS[62]))) if len(grams) else 0


def band_hashes(held: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """The hash of each band of rows registers, of each row of registers."""
    hashes = np.zeros((len(held), held.shape[1] // rows), np.uint64) + np.arange(1, held.shape[1] // rows + 1, dtype=np.uint64) * _STEPS[63]
    for r in range(rows):
        hashes = mixed(hashes * _STEPS[61] + held[:, r::rows].astype(np.uint64))
    return hashes


def sketches(docs: DataFrame, shingle: int, threshold: float, rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, n (set size), a 128-bit digest of the set, registers and band hashes. No shuffle."""
    bands = band_count(threshold, rows)
    m = bands * rows

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            sizes, digests, regs = [], [], []
            for i, j in runs_of(offsets, 1_000_000):
                for grams in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle):
                    sizes.append(len(grams))
                    digests.append(digest_of(grams))
                    regs.append(registers(grams, m))
            held = np.stack(regs) if regs else np.zeros((0, m), np.uint16)
            hashes = band_hashes(held, rows)
            d = np.array(digests, dtype=np.uint64).reshape(-1, 2)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), *(pa.array(np.ascontiguousarray(d[:, i]).view(np.int64)) for i in (0, 1)), pa.array([r.tobytes() for r in held], pa.binary()), pa.ListArray.from_arrays(np.arange(0, hashes.size + 1, bands, dtype=np.int32), hashes.reshape(-1).view(np.int64))],
                names=["doc_id", "n", "d1", "d2", "regs", "bands"],
            )

    return docs.mapInArrow(sketch, "doc_id long, n long, d1 long, d2 long, regs binary, bands array<long>")


def with_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """Per row: id, digest and its sorted set as little-endian 64-bit hashes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            out, digests = [], []
            for i, j in runs_of(offsets, 1_000_000):
                for grams in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle):
                    out.append(grams.tobytes())
                    digests.append(digest_of(grams))
            d = np.array(digests, dtype=np.uint64).reshape(-1, 2)
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(np.ascontiguousarray(d[:, i]).view(np.int64)) for i in (0, 1)), pa.array(out, pa.binary())], names=["id", "d1", "d2", "grams"])

    return docs.select("doc_id", "text").mapInArrow(sets, "id long, d1 long, d2 long, grams binary")


def enough(shared: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (n_a + n_b - shared)


def near_groups(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept. Links: 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    threshold = percent / 100
    plain = text_column(docs)
    sketched = written(sketches(plain, shingle, threshold), "sketches")
    classes = sketched.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
    membership = written(sketched.select("doc_id", "n", "d1", "d2").join(classes, ["d1", "d2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), "rep"), "classes")

    # Of rows with one doc_id and different sets, the least digest's stands for the id.
    reps = sketched.join(membership.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi").where("n > 0")
    reps = reps.groupBy("doc_id").agg(F.min(F.struct("d1", "d2", "n", "regs", "bands")).alias("s")).select(F.col("doc_id").alias("id"), "s.*")
    banded = written(reps.select("id", F.explode("bands").alias("band")), "bands")
    stars = banded.groupBy("band").agg(F.min("id").alias("centre"), F.max("id").alias("other")).where("centre < other").select("band", "centre")
    starred = written(banded.join(stars, "band"), "buckets")
    candidates = written(starred.groupBy("id").agg(F.min("centre").alias("centre")), "candidates")
    held = reps.join(candidates.select("id"), "id", "left_semi").select("id", "n", "d1", "d2", "regs")
    texts = plain.join(candidates.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    held = written(held.join(with_sets(texts, shingle), ["id", "d1", "d2"]).dropDuplicates(["id"]).drop("d1", "d2"), "sets")

    # Each candidate against the smallest centre of its buckets: one pair a candidate.
    labels = candidates.select("id", F.col("id").alias("component"))
    firsts = candidates.where("id > centre").select("id", "centre", F.col("id").alias("a"), F.col("centre").alias("b"))
    labels = merged(labels, component_labels(confirmed(firsts, held, percent)))

    # Buckets that hold several components yet: those outside the component of the bucket's centre against that centre.
    placed = starred.join(labels, "id").select("id", "band", "component")
    several = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct("id", "component")).alias("c")).where("low < high")
    pairs = placed.join(several, "band").where("component <> c.component").select("id", F.col("c.id").alias("centre"), F.col("component").alias("a"), F.col("c.component").alias("b")).distinct()
    labels = merged(labels, component_labels(confirmed(pairs, held, percent)))

    # Buckets that are still open.
    placed = starred.join(labels, "id").select("id", "band", "component", "centre")
    several = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
    loose = written(placed.join(several, "band").select("id", "band", "component", "centre"), "loose")
    # Of an id's centres the least stands for it, and is joined to the others: only centres are left to be connected.
    tied = loose.groupBy("id").agg(F.min("centre").alias("hub"), F.collect_set("centre").alias("centres"))
    tied = written(tied, "hubs")
    between = component_labels(tied.select(F.col("hub").alias("a"), F.explode("centres").alias("b")).where("a <> b").distinct())
    clusters = tied.join(between.select(F.col("id").alias("hub"), "component"), "hub", "left").select("id", F.coalesce("component", "hub").alias("cluster"))
    members = written(in_clusters_or_buckets(loose.select("id", "band", "component").join(clusters, "id"), held).join(held, "id"), "members")
    found = in_blocks_of_clusters(members).groupBy("group", "i", "j").applyInArrow(lambda table: links_between(table, percent), "a long, b long")
    labels = merged(labels, component_labels(found))

    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    out = membership.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def merged(labels: DataFrame, joined: DataFrame) -> DataFrame:
    """labels (id, component) after components have been joined: (id, component) of components."""
    new = joined.select(F.col("id").alias("component"), F.col("component").alias("_to"))
    return written(labels.join(new, "component", "left").select("id", F.coalesce("_to", "component").alias("component")), "labels")


def confirmed(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The a and b of pairs (id, centre, a, b) whose sets are alike: by size, by the likelihood of their registers, then by the full sets."""
    left = held.select("id", F.col("n").alias("n_a"), F.col("regs").alias("regs_a"), F.col("grams").alias("grams_a"))
    right = held.select(F.col("id").alias("centre"), F.col("n").alias("n_b"), F.col("regs").alias("regs_b"), F.col("grams").alias("grams_b"))
    sized = pairs.join(left, "id").join(right, "centre").where((100 * F.least("n_a", "n_b")) >= percent * F.greatest("n_a", "n_b"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(len(batch), -1) for c in ("regs_a", "regs_b"))
            up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
            _, likely = likelihoods(up, down, (a == b).sum(axis=1), n_a, n_b, percent / 100)
            rows = np.flatnonzero(likely)
            shared = np.array([len(np.intersect1d(*(np.frombuffer(batch.column(c)[int(i)].as_buffer(), np.uint64) for c in ("grams_a", "grams_b")), assume_unique=True)) for i in rows], dtype=np.int64)
            linked = pa.array(rows[enough(shared, n_a[rows], n_b[rows], percent)])
            yield pa.record_batch([batch.column(c).take(linked) for c in ("a", "b")], names=["a", "b"])

    return sized.mapInArrow(confirm, "a long, b long")


def in_clusters_or_buckets(loose: DataFrame, held: DataFrame) -> DataFrame:
    """Members (id, component, cluster, bucket) that meet, of rows (id, band, component, cluster) of open buckets: of a cluster's members, or of a bucket's (bucket is true and cluster the band).

    Buckets that chance members hang together make clusters that grow much faster than the input, and hardly any two members
    share a bucket. Where a cluster is larger than a block and its buckets have fewer pairs than itself, they take its place.
    """
    ids = written(loose.select("id", "component", "cluster").distinct().join(held.select("id", "n"), "id"), "ids")
    whole = ids.groupBy("cluster").agg(F.count(F.lit(1)).cast("double").alias("c"), (F.sum("n") * 8).alias("b"))
    buckets = loose.groupBy("cluster", "band").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy("cluster").agg(F.sum(F.col("c") * F.col("c")).alias("pairs"))
    large = whole.where((F.col("c") > BLOCK_MEMBERS) | (F.col("b") > BLOCK_SET_BYTES))
    sparse = written(large.join(buckets, "cluster").where(F.col("c") * F.col("c") > F.col("pairs")).select("cluster"), "sparse")
    by_bucket = loose.join(sparse, "cluster", "left_semi").select("id", "component", F.col("band").alias("cluster"), F.lit(True).alias("bucket"))
    return by_bucket.unionByName(ids.join(sparse, "cluster", "left_anti").select("id", "component", "cluster", F.lit(False).alias("bucket")))


def in_blocks_of_clusters(members: DataFrame) -> DataFrame:
    """members (id, component, cluster, bucket, n, regs, grams) in groups of two blocks at most (group, i, j, own), so that all members of different components of a cluster (or bucket) meet.

    A cluster's largest component needs no comparison with itself: its blocks meet those of the other members alone. So a
    large component beside a few others is sent once, and only members outside it are compared in all pairs of blocks.
    """
    counted = members.groupBy("cluster", "bucket", "component").agg(F.count(F.lit(1)).alias("c"), (F.sum("n") * 8).alias("b"))
    sizes = counted.groupBy("cluster", "bucket").agg(F.sum("c").alias("c"), F.sum("b").alias("b"), F.max(F.struct("c", "b", "component")).alias("top"))
    blocks = lambda c, b: F.greatest(F.lit(1), F.ceil(c / BLOCK_MEMBERS), F.ceil(b / BLOCK_SET_BYTES)).cast("int")
    sizes = sizes.select("cluster", "bucket", F.col("top.component").alias("top"), blocks(F.col("c"), F.col("b")).alias("all"), blocks(F.col("top.c"), F.col("top.b")).alias("most"), blocks(F.col("c") - F.col("top.c"), F.col("b") - F.col("top.b")).alias("rest"))
    total = members.agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")).first()
    groups = max(1, math.ceil(total["c"] / MEMBERS_A_GROUP), math.ceil(8 * (total["n"] or 0) / BLOCK_SET_BYTES))
    one, largest = F.col("all") == 1, F.col("component") == F.col("top")
    own = F.when(one, 0).when(largest, F.pmod(F.xxhash64("id"), F.col("most"))).otherwise(F.col("most") + F.pmod(F.xxhash64("id"), F.col("rest"))).cast("int")
    last = F.col("most") + F.col("rest") - 1
    others = F.when(one, F.array(F.lit(0))).when(largest, F.sequence(F.col("most"), last)).otherwise(F.sequence(F.lit(0), last))
    dealt = members.join(sizes, ["cluster", "bucket"]).withColumn("own", own).withColumn("with", F.explode(others))
    group = F.when(one, F.pmod(F.xxhash64("cluster"), F.lit(groups))).otherwise(F.col("cluster"))
    return dealt.select(group.alias("group"), F.when(one, -1).otherwise(F.least("own", "with")).alias("i"), F.greatest("own", "with").alias("j"), "own", "cluster", "bucket", "id", "component", "n", "regs", "grams")


def links_between(table: pa.Table, percent: int) -> pa.Table:
    """Links that connect different components, of the members of one block with another (or of many small clusters and buckets). Of a bucket, pairs that share no earlier one."""
    table = table.sort_by([("cluster", "ascending"), ("bucket", "ascending"), ("own", "ascending"), ("id", "ascending")])
    comp, cluster, bucket, own, n = (long_column(table.column(c)) for c in ("component", "cluster", "bucket", "own", "n"))
    data, offsets = column_bytes(table.column("grams"))
    grams, at = data.view(np.uint64), offsets // 8
    regs = column_bytes(table.column("regs"))[0].view(np.uint16).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, ROWS), np.uint16)
    label = comp.copy()  # the least component that each member is connected with so far
    links = []
    borders = np.concatenate(([0], np.flatnonzero((np.diff(cluster) != 0) | (np.diff(bucket) != 0)) + 1, [table.num_rows]))
    for lo, hi in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        if hi - lo < 2:
            continue
        _, local = np.unique(grams[at[lo] : at[hi]], return_inverse=True)
        start, size, mine, places = at[lo:hi] - at[lo], n[lo:hi], own[lo:hi], np.arange(hi - lo)
        mark = np.zeros(int(local.max()) + 1, bool)
        if bucket[lo]:
            bands = band_hashes(regs[lo:hi])
            bands = bands[:, : int(np.flatnonzero(bands[0].view(np.int64) == cluster[lo])[0])]  # those before this bucket's own
        two = mine[0] != mine[-1]
        for x in range(hi - lo):
            # blocks i < j: members of i against those of j; one block: each against those after it
            y = places[int(np.searchsorted(mine, mine[x] + 1)) if two else x + 1 :]
            y = y[(label[lo + y] != label[lo + x]) & (100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x]))]
            if bucket[lo] and len(y):
                y = y[~(bands[y] == bands[x]).any(axis=1)]
            if not len(y):
                continue
            mark[local[start[x] : start[x] + size[x]]] = True
            ends = np.cumsum(size[y])
            held = np.repeat(start[y] - (ends - size[y]), size[y]) + np.arange(ends[-1])
            shared = np.add.reduceat(mark[local[held]], ends - size[y], dtype=np.int64)
            mark[local[start[x] : start[x] + size[x]]] = False
            for z in y[enough(shared, size[x], size[y], percent)].tolist():
                p, q = int(label[lo + x]), int(label[lo + z])
                if p != q:
                    label[label == max(p, q)] = min(p, q)
                    links.append((int(comp[lo + x]), int(comp[lo + z])))
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def filtered(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each near-duplicate group, the smallest doc_id."""
    lost = near_groups(docs.select("doc_id", "text"), shingle, percent).where(~F.col("kept")).select("doc_id")
    return docs.join(lost, "doc_id", "left_anti")


def digest(docs: DataFrame) -> DataFrame:
    """The query's result: three-word shingles, 85 percent."""
    return near_groups(docs, 3, 85)


#: The query's result by all pairs that share a shingle.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
  edges AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)),
  reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
  least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id, d.doc_id <= coalesce(b, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_of l ON l.a = d.doc_id
"""
