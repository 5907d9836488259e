"""Approximate nearest neighbours by inner product: NN-descent builds a neighbour graph, queries search it greedily.

Equal vectors are one node. The graph starts from blocks of random-projection trees (all pairs of a block in one matrix
product, the best of each row kept) and improves in rounds: a node's list and a sample of the nodes that list it meet, and
each of them takes the others that beat its own list, one of the two being new. Rounds end when few entries change. A
query walks the graph from its own node: the best nodes of its beam that are not expanded yet give their links, and the
beam keeps the best of what it has seen. What the beam holds at last is scored again in double precision on the
original vectors, and copies of nodes come back as rows.

Nearness within the graph is the cosine, in the search the inner product; both come from codes of one byte a component.
Where lengths of vectors differ, long ones win inner products whatever their direction, so the longest LONGEST vectors
are candidates of each query too.

What is bounded, by parameters that do not depend on the table: a list (LISTED), the sample of a node's reverse links
(REVERSE, by hash, as in the published method), the rows that trees are fitted on (TREE_ROWS, by hash; each row is then
placed), a block (BLOCK rows, and CENTRES lists), a beam (BEAM). All rows are indexed. Recall is measured in tests.

Edge cases: rows whose vector is null, empty, all zero or holds a null or non-finite component, and rows without vec_id
take no part. Of rows with one vec_id the one whose vector sorts least stands for all. Shorter vectors count as
filled up with zeros. Ties go to the smaller vec_id. An empty table gives an empty result, other columns are ignored.
Each round is written to the shared folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import blobs, column_bytes, long_column, release, tables_written, written

NEAREST = 20
LISTED, REVERSE = 48, 24
TREES, TREE_ROWS, BLOCK, CENTRES = 4, 8192, 1024, 256
ROUNDS, SETTLED = 12, 0.03
BEAM, EXPANDED, STEPS, LONGEST = 128, 32, 5, 256
STATE = "id long, block long, code binary, nbrs binary, sims binary, fresh binary"
BEAMS = "id long, block long, code binary, nbrs binary, sims binary, done binary, chosen binary"


# --- packed columns ------------------------------------------------------------------------------------------------

def unpacked(column: pa.Array | pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values of a packed binary column, end to end, and where each row's begin."""
    data, offsets = column_bytes(column)
    return np.frombuffer(data.tobytes(), kind), offsets // np.dtype(kind).itemsize


def matrix(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Codes as unit rows (float32), and the length of each vector."""
    data, offsets = column_bytes(column)
    rows = data.reshape(len(offsets) - 1, -1) if len(offsets) > 1 else np.zeros((0, 9), np.uint8)
    scale = np.frombuffer(rows[:, :8].tobytes(), np.float64)
    codes = rows[:, 8:].view(np.int8).astype(np.float32)
    norm = np.sqrt(np.einsum("ij,ij->i", codes, codes, dtype=np.float64))
    return codes / norm[:, None].astype(np.float32), scale * norm


def best(rows: np.ndarray, others: np.ndarray, sims: np.ndarray, flags: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Per row its `most` nearest others, nearest first (ties: smaller), each once, with the least flag it came with."""
    order = np.lexsort((flags, others, rows))
    rows, others, sims, flags = rows[order], others[order], sims[order], flags[order]
    once = np.ones(len(rows), bool)
    once[1:] = (rows[1:] != rows[:-1]) | (others[1:] != others[:-1])
    rows, others, sims, flags = rows[once], others[once], sims[once], flags[once]
    order = np.lexsort((others, -sims, rows))
    rows, others, sims, flags = rows[order], others[order], sims[order], flags[order]
    first = np.ones(len(rows), bool)
    first[1:] = rows[1:] != rows[:-1]
    starts = np.flatnonzero(first)
    rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
    keep = rank < most
    return rows[keep], others[keep], sims[keep], flags[keep]


def lists_of(rows: np.ndarray, n: int, *values: np.ndarray) -> list[pa.Array]:
    """Packed columns of n rows out of values sorted by row number."""
    bounds = np.searchsorted(rows, np.arange(n + 1))
    return [blobs(v, bounds) for v in values]


# --- vectors -------------------------------------------------------------------------------------------------------

def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors that take part, as doubles, one a vec_id."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    return rows.where(F.col("vec_id").isNotNull() & whole & F.exists("v", lambda x: x != 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def coded(nodes: DataFrame, dim: int) -> DataFrame:
    """(id, code): a scale (8 bytes) and a byte a component, of (id, v)."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            sizes = np.diff(np.asarray(column.offsets))
            dense = np.zeros((len(sizes), dim))
            dense[np.arange(dim)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
            scale = np.abs(dense).max(axis=1) / 127
            scale = np.where(scale > 0, scale, 5e-324)
            rows = np.empty((len(sizes), 8 + dim), np.uint8)
            rows[:, :8] = scale[:, None].view(np.uint8)
            rows[:, 8:] = np.clip(np.rint(dense / scale[:, None]), -127, 127).astype(np.int8).view(np.uint8)
            yield pa.record_batch([batch.column("id"), blobs(rows.ravel(), np.arange(len(rows) + 1) * (8 + dim))], names=["id", "code"])

    return nodes.select("id", "v").mapInArrow(code, "id long, code binary")


# --- trees ---------------------------------------------------------------------------------------------------------

Tree = tuple[np.ndarray, np.ndarray]


def fitted_tree(sample: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
    """Normals and thresholds of a balanced tree, children of node i at 2i+1 and 2i+2."""
    normals, thresholds = np.zeros((2**depth - 1, sample.shape[1]), np.float32), np.zeros(2**depth - 1, np.float32)
    parts = [np.arange(len(sample))]
    for i in range(2**depth - 1):
        part = parts[i]
        if len(part) > 1:
            a, b = rng.choice(part, 2, replace=False)
            normals[i] = sample[a] - sample[b]
            at = sample[part] @ normals[i]
            thresholds[i] = np.median(at)
            parts += [part[at <= thresholds[i]], part[at > thresholds[i]]]
        else:
            parts += [part, part[:0]]
    return normals, thresholds


def leaves(rows: np.ndarray, tree: Tree, depth: int) -> np.ndarray:
    node = np.zeros(len(rows), np.int64)
    for _ in range(depth):
        node = 2 * node + 1 + (np.einsum("ij,ij->i", rows, tree[0][node]) > tree[1][node])
    return node - (2**depth - 1)


def planted(nodes: DataFrame, n: int) -> DataFrame:
    """(id, code, leaf array): the leaf of each node in each tree."""
    spark = nodes.sparkSession
    held = nodes.orderBy(F.xxhash64("id"), "id").limit(TREE_ROWS).toArrow()
    sample = matrix(held["code"])[0]
    depth = max(0, min(math.ceil(math.log2(max(1, n / BLOCK))), int(math.log2(max(1, len(sample) / 8)))))
    rng = np.random.default_rng(11)
    trees = spark.sparkContext.broadcast([fitted_tree(sample, depth, rng) for _ in range(TREES)])

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = matrix(batch.column("code"))[0]
            at = np.stack([leaves(unit, tree, depth) + (t << 32) for t, tree in enumerate(trees.value)], axis=1)
            columns = [batch.column("id"), batch.column("code"), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * TREES, pa.int32()), pa.array(at.ravel()))]
            yield pa.record_batch(columns, names=["id", "code", "leaf"])

    return nodes.mapInArrow(plant, "id long, code binary, leaf array<long>")


def parts_of(counts: DataFrame, size: int) -> DataFrame:
    """(leaf, parts): in how many parts a leaf of so many rows is dealt."""
    return counts.select("leaf", F.ceil(F.col("count") / F.lit(size)).cast("long").alias("parts"))


def begun(nodes: DataFrame, n: int) -> DataFrame:
    """The first state: each node with its nearest of the tree blocks it is in."""
    at = written(planted(nodes, n), "leaves")
    exploded = at.select("id", "code", F.explode("leaf").alias("leaf"))
    counts = written(exploded.groupBy("leaf").count(), "leaf-counts")
    dealt = exploded.join(F.broadcast(parts_of(counts, BLOCK)), "leaf").select("id", "code", F.xxhash64("leaf", F.pmod(F.xxhash64("id"), "parts")).alias("block"))

    def near(block: pa.Table) -> pa.Table:
        ids, unit = long_column(block["id"]), matrix(block["code"])[0]
        order = np.argsort(ids)
        ids, unit, most = ids[order], unit[order], min(LISTED, len(ids) - 1)
        if not most:
            return pa.table([block["id"].slice(0, 0)] + [pa.array([], pa.binary())] * 2, names=["id", "nbrs", "sims"])
        kept = []
        for a in range(0, len(ids), 256):
            sims = unit[a : a + 256] @ unit.T
            sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -9
            top = np.argpartition(-sims, most - 1, axis=1)[:, :most]
            kept.append((top, np.take_along_axis(sims, top, 1)))
        bounds = np.arange(len(ids) + 1) * most
        return pa.table([pa.array(ids), blobs(ids[np.concatenate([k[0] for k in kept]).ravel()], bounds), blobs(np.concatenate([k[1] for k in kept]).ravel().astype(np.float32), bounds)], names=["id", "nbrs", "sims"])

    found = dealt.groupBy("block").applyInArrow(near, "id long, nbrs binary, sims binary")
    home = at.select("id", "code", F.col("leaf")[0].alias("leaf")).join(F.broadcast(parts_of(counts, CENTRES)), "leaf").select("id", F.xxhash64("leaf", F.pmod(F.xxhash64("id", F.lit(1)), "parts")).alias("block"), "code")
    nothing = F.lit(b"")
    return merged(home.select("*", nothing.alias("nbrs"), nothing.alias("sims"), nothing.alias("fresh")), found)


# --- rounds --------------------------------------------------------------------------------------------------------

def merged(state: DataFrame, found: DataFrame) -> DataFrame:
    """The state with what was found, flags 1 on entries that are new; written."""
    both = state.select("id", "block", "code", "nbrs", "sims").unionByName(found, allowMissingColumns=True).repartition("id").sortWithinPartitions("id")

    def folded(rows: pa.Table) -> pa.Table:
        ids = long_column(rows["id"])
        own = ~np.asarray(rows["code"].is_null().to_numpy(zero_copy_only=False), bool) if len(ids) else np.zeros(0, bool)
        places, at = np.unique(ids, return_inverse=True)
        nbrs, bounds = unpacked(rows["nbrs"], np.int64)
        each = np.diff(bounds)
        row, other, sim, flag = best(np.repeat(at, each), nbrs, unpacked(rows["sims"], np.float32)[0], np.repeat(~own, each).astype(np.uint8), LISTED)
        lists = lists_of(row, len(places), other, sim, flag)
        place = np.full(len(places), -1)
        place[at[own]] = np.flatnonzero(own)
        take = pa.array(np.where(place < 0, None, place) if (place < 0).any() else place, pa.int64())
        return pa.table([pa.array(places), rows["block"].combine_chunks().take(take), rows["code"].combine_chunks().take(take), *lists], names=["id", "block", "code", "nbrs", "sims", "fresh"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < 4096:
                continue
            rows = pa.Table.from_batches(held)
            ids = long_column(rows["id"])
            cut = int(np.searchsorted(ids, ids[-1]))
            if cut:
                yield from folded(rows.slice(0, cut)).to_batches()
                held, n = rows.slice(cut).to_batches(), len(ids) - cut
            else:  # one node fills all: fold it, as an entry of the lists only
                one = folded(rows)
                held = one.select(["id", "block", "code", "nbrs", "sims"]).to_batches()
                n = 1
        if held:
            yield from folded(pa.Table.from_batches(held)).to_batches()

    return written(both.mapInArrow(fold, STATE), "neighbours")


def links(state: DataFrame, most: int) -> DataFrame:
    """(id, rev, rev_fresh): of each node a sample of those that list it, as packed columns."""

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nbrs, bounds = unpacked(batch.column("nbrs"), np.int64)
            yield pa.record_batch([pa.array(nbrs), pa.array(np.repeat(long_column(batch.column("id")), np.diff(bounds))), pa.array(unpacked(batch.column("fresh"), np.int8)[0])], names=["id", "by", "fresh"])

    rows = state.select("id", "nbrs", "fresh").mapInArrow(turned, "id long, by long, fresh byte")
    few = rows.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("fresh"), F.xxhash64("id", "by"), "by"))).where(F.col("_n") <= most)
    return few.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("by", "fresh"))).alias("rev"))


def improved(state: DataFrame) -> DataFrame:
    """One round: what the members of each node's lists find in one another."""
    with_rev = state.join(links(state, REVERSE), "id", "left")

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            own = long_column(batch.column("id"))
            nbrs, bounds = unpacked(batch.column("nbrs"), np.int64)
            fresh = unpacked(batch.column("fresh"), np.uint8)[0]
            rev = batch.column("rev")
            rev_bounds = np.concatenate(([0], np.cumsum(np.asarray(rev.value_lengths().fill_null(0)))))
            flat = rev.flatten()
            by, by_fresh = long_column(flat.field(0)), np.asarray(flat.field(1)).astype(np.uint8)
            for i in range(len(own)):
                members = np.concatenate((nbrs[bounds[i] : bounds[i + 1]], by[rev_bounds[i] : rev_bounds[i + 1]]))
                flags = np.concatenate((fresh[bounds[i] : bounds[i + 1]], by_fresh[rev_bounds[i] : rev_bounds[i + 1]]))
                if flags.any():
                    members, first, at = np.unique(members, return_index=True, return_inverse=True)
                    some = np.zeros(len(members), np.uint8)
                    np.maximum.at(some, at, flags)
                    out.append((own[i], i, members.tobytes(), some.tobytes()))
            yield pa.record_batch([pa.array([o[0] for o in out], pa.int64()), batch.column("block").take(pa.array([o[1] for o in out], pa.int64())), pa.array([o[2] for o in out], pa.binary()), pa.array([o[3] for o in out], pa.binary())], names=["id", "block", "members", "flags"])

    groups = written(with_rev.select("id", "block", "nbrs", "fresh", "rev").mapInArrow(gathered, "id long, block long, members binary, flags binary"), "groups")
    needed = placed(groups, "members").join(state.select("id", "code", "nbrs", "sims"), "id")

    def meet(lists: pa.Table, codes: pa.Table) -> pa.Table:
        ids = long_column(codes["id"])
        order = np.argsort(ids)
        ids, unit = ids[order], matrix(codes["code"])[0][order]
        listed = np.diff(unpacked(codes["nbrs"], np.int64)[1])
        sims, bounds = unpacked(codes["sims"], np.float32)
        last = np.full(len(listed), -9, np.float32)
        full = listed >= LISTED
        last[full] = sims[bounds[1:][full] - 1]
        last = last[order]
        members, at = unpacked(lists["members"], np.int64)
        flags = unpacked(lists["flags"], np.uint8)[0].astype(bool)
        places = np.searchsorted(ids, members)
        rows, others, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for a, b in zip(at[:-1], at[1:], strict=True):
            m, new = places[a:b], flags[a:b]
            near = unit[m] @ unit[m].T
            better = (near > last[m][:, None]) & (new[:, None] | new[None, :])
            better[np.arange(b - a), np.arange(b - a)] = False
            x, y = np.nonzero(better)
            rows.append(m[x])
            others.append(m[y])
            found.append(near[x, y])
        row, other, sim, _ = best(np.concatenate(rows), np.concatenate(others), np.concatenate(found), np.zeros(sum(map(len, rows)), np.uint8), LISTED)
        nodes, row = np.unique(row, return_inverse=True)
        return pa.table([pa.array(ids[nodes]), *lists_of(row, len(nodes), ids[other], sim)], names=["id", "nbrs", "sims"])

    found = groups.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(meet, "id long, nbrs binary, sims binary")
    return merged(state, found)


def placed(rows: DataFrame, column: str) -> DataFrame:
    """(block, id), each once: the nodes that the packed column of a block's rows names."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bounds = unpacked(batch.column(column), np.int64)
            pairs = np.unique(np.stack([np.repeat(long_column(batch.column("block")), np.diff(bounds)), ids], axis=1), axis=0)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["block", "id"])

    return rows.select("block", column).mapInArrow(named, "block long, id long").distinct()


def neighbour_graph(nodes: DataFrame) -> DataFrame:
    """The state (id, block, code, nbrs, sims, fresh) of the neighbour graph over (id, v)."""
    n, dim = (x or 0 for x in nodes.agg(F.count("*"), F.max(F.size("v"))).first())
    mark = tables_written()
    state = begun(written(coded(nodes, max(1, dim)), "codes"), n)
    for _ in range(ROUNDS):
        changed = F.aggregate(F.split(F.hex("fresh"), ""), F.lit(0), lambda s, c: s + (c == "1").cast("int"))
        news = state.agg(F.sum(changed)).first()[0] or 0
        if news <= SETTLED * LISTED * n:
            break
        state = improved(state)
        release(mark, keep=1)
    return state


# --- search --------------------------------------------------------------------------------------------------------

def searched(graph: DataFrame, queries: DataFrame) -> DataFrame:
    """(id, nbrs): what the beams of the queries (ids of nodes) hold at last, packed."""
    nothing = F.lit(b"")
    rev = links(graph, LISTED).select("id", F.transform("rev", lambda r: r["by"]).alias("rev"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nbrs, bounds = unpacked(batch.column("nbrs"), np.int64)
            back = batch.column("rev")
            by, at = long_column(back.flatten()), np.concatenate(([0], np.cumsum(np.asarray(back.value_lengths().fill_null(0)))))
            lists = [np.union1d(nbrs[bounds[i] : bounds[i + 1]], by[at[i] : at[i + 1]]).tobytes() for i in range(batch.num_rows)]
            yield pa.record_batch([batch.column("id"), pa.array(lists, pa.binary())], names=["id", "links"])

    net = written(graph.join(rev, "id", "left").select("id", "nbrs", "rev").mapInArrow(linked, "id long, links binary"), "links")
    codes = graph.select("id", "code")

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("id"), pa.array(matrix(batch.column("code"))[1])], names=["id", "length"])

    longest = np.array([r["id"] for r in codes.mapInArrow(lengths, "id long, length double").orderBy(F.desc("length"), "id").limit(LONGEST).collect()], np.int64)
    beams = queries.join(graph, "id").select("id", "block", "code", nothing.alias("nbrs"), nothing.alias("sims"), nothing.alias("done"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nbrs, bounds = unpacked(batch.column("nbrs"), np.int64)
            done = unpacked(batch.column("done"), np.uint8)[0].copy()
            ids, chosen = long_column(batch.column("id")), []
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                at = a + np.flatnonzero(done[a:b] == 0)[:EXPANDED]
                done[at] = 1
                chosen.append((ids[i : i + 1] if a == b else nbrs[at]).tobytes())
            yield pa.record_batch([*(batch.column(c) for c in ("id", "block", "code", "nbrs", "sims")), blobs(done, bounds), pa.array(chosen, pa.binary())], names=["id", "block", "code", "nbrs", "sims", "done", "chosen"])

    def follow(rows: pa.Table, lists: pa.Table) -> pa.Table:
        ids = long_column(lists["id"])
        order = np.argsort(ids)
        ids = ids[order]
        out, at = unpacked(lists["links"], np.int64)
        chosen, bounds = unpacked(rows["chosen"], np.int64)
        nbrs, have = unpacked(rows["nbrs"], np.int64)
        own, found = long_column(rows["id"]), []
        for i in range(len(own)):
            to = order[np.searchsorted(ids, chosen[bounds[i] : bounds[i + 1]])]
            seeds = [own[i : i + 1], longest] if have[i] == have[i + 1] else []
            reached = np.unique(np.concatenate([np.zeros(0, np.int64), *seeds, *(out[at[t] : at[t + 1]] for t in to)]))
            found.append(np.setdiff1d(reached, nbrs[have[i] : have[i + 1]], assume_unique=True).tobytes())
        return pa.table([rows[c] for c in ("id", "block", "code", "nbrs", "sims", "done")] + [pa.array(found, pa.binary())], names=["id", "block", "code", "nbrs", "sims", "done", "chosen"])

    def score(rows: pa.Table, near: pa.Table) -> pa.Table:
        ids = long_column(near["id"])
        order = np.argsort(ids)
        ids, (unit, length) = ids[order], (x[order] for x in matrix(near["code"]))
        mine, _ = matrix(rows["code"])
        reached, bounds = unpacked(rows["chosen"], np.int64)
        nbrs, have = unpacked(rows["nbrs"], np.int64)
        places = np.searchsorted(ids, reached)
        got = np.concatenate([np.zeros(0), *((unit[places[a:b]] @ mine[i]) * length[places[a:b]] for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if a < b)])
        n = len(mine)
        row = np.concatenate((np.repeat(np.arange(n), np.diff(have)), np.repeat(np.arange(n), np.diff(bounds))))
        flags = np.concatenate((1 - unpacked(rows["done"], np.uint8)[0], np.ones(len(reached), np.uint8)))
        row, other, sim, open_ = best(row, np.concatenate((nbrs, reached)), np.concatenate((unpacked(rows["sims"], np.float64)[0], got)), flags, BEAM)
        done = np.where(other == long_column(rows["id"])[row], 1, 1 - open_).astype(np.uint8)
        return pa.table([rows["id"], rows["block"], rows["code"], *lists_of(row, n, other, sim.astype(np.float64), done)], names=["id", "block", "code", "nbrs", "sims", "done"])

    mark = tables_written()
    for _ in range(STEPS):
        asked = written(beams.mapInArrow(choose, BEAMS), "beams")
        release(mark, keep=1)
        if asked.where(F.length("chosen") > 0).limit(1).count() == 0:
            beams = asked
            break
        reached = written(asked.groupBy("block").cogroup(placed(asked, "chosen").join(net, "id").groupBy("block")).applyInArrow(follow, BEAMS), "reached")
        release(mark, keep=1)
        beams = reached.groupBy("block").cogroup(placed(reached, "chosen").join(codes, "id").groupBy("block")).applyInArrow(score, BEAMS.removesuffix(", chosen binary"))
    return written(beams.select("id", "nbrs"), "beams")


def nearest(embeddings: DataFrame, is_query, k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row for which is_query(vec_id) holds, its k nearest other rows."""
    rows = written(vectors(embeddings), "vectors")
    nodes = written(rows.groupBy("v").agg(F.min("vec_id").alias("id")), "nodes")
    named = written(rows.join(nodes, "v").select("vec_id", "id"), "named")
    asked = named.where(is_query(F.col("vec_id")))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nbrs, bounds = unpacked(batch.column("nbrs"), np.int64)
            yield pa.record_batch([pa.array(np.repeat(long_column(batch.column("id")), np.diff(bounds))), pa.array(nbrs)], names=["q", "id"])

    met = searched(neighbour_graph(nodes.select("id", "v")), asked.select("id").distinct()).mapInArrow(pairs, "q long, id long")
    product = F.aggregate(F.zip_with("v", "w", lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    scored = met.join(nodes, "id").join(nodes.select(F.col("id").alias("q"), F.col("v").alias("w")), "q").select("q", "id", product.alias("score"))
    copies = named.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))).where(F.col("_n") <= k + 1).select("id", "vec_id")
    order = [F.desc("score"), F.col("vec_id")]
    # k + 1 rows a node serve all queries that are its copies: a query itself is one of them at most.
    held = scored.join(copies, "id").withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("_n") <= k + 1).select("q", "vec_id", "score")
    held = held.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("held"))
    own = asked.select(F.col("vec_id").alias("query_id"), F.col("id").alias("q")).join(held, "q")
    others = F.slice(F.filter("held", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("n", "h")).select("query_id", (F.col("n") + 1).cast("int").alias("rank"), F.col("h.vec_id").alias("vec_id"), (-F.col("h.s")).alias("score"))


def digest(embeddings: DataFrame) -> DataFrame:
    """The query's columns: rows whose vec_id is divisible by 20, each with its NEAREST nearest."""
    return nearest(embeddings, lambda vec_id: vec_id % 20 == 0)
