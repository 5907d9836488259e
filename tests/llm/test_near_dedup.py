"""Near-duplicate groups against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from larkspur.llm import near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(texts, k, percent):
    sets = {d: shingles(t, k) for d, t in texts.items()}
    parent = {d: d for d in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_against_all_pairs(spark, prose, k, percent):
    rng = random.Random(k)
    texts, base = {}, [prose(n, n) for n in (3, 12, 40, 90, 200)]
    for d in range(260):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
            words[rng.randrange(len(words))] = f"new{rng.randrange(30)}"
        texts[d] = " ".join(words)
    got = near_dedup.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7), k, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == groups(texts, k, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_chains_of_variants_in_several_blocks(spark, prose, monkeypatch):
    """A long chain of texts, each near the next only, and blocks much smaller than the group."""
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 16)
    monkeypatch.setattr(near_dedup, "MEMBERS_A_GROUP", 20)
    words, texts = prose(120, 9).split(), {}
    for d in range(120):
        words[(d * 7) % 120] = f"v{d}"
        texts[500 - d] = " ".join(words)
    got = near_dedup.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 5, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == groups(texts, 5, 80)


def test_a_cluster_that_chance_members_hang_together(spark, prose, monkeypatch):
    """Families along one long text, each half alike with the next: a single cluster, of which only those that share a bucket meet."""
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 16)
    dealt, whole = [], near_dedup.in_blocks_of_clusters
    monkeypatch.setattr(near_dedup, "in_blocks_of_clusters", lambda members: dealt.append(whole(members)) or dealt[-1])
    rng, words, texts = random.Random(5), [f"{w}{i}" for i, w in enumerate(prose(4_300, 9).split())], {}
    for d, i in enumerate(rng.sample(range(400), 400)):
        own = words[i // 4 * 40 :][:160]
        for _ in range(rng.choice([0, 1, 2, 4])):
            own[rng.randrange(160)] = f"new{rng.randrange(9)}"
        texts[d] = " ".join(own)
    got = near_dedup.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == groups(texts, 3, 85)
    met = [r["count"] for r in dealt[0].groupBy("group", "i", "j", "cluster").count().collect()]
    members = dealt[0].select("id").distinct().count()
    assert members > 100 and sum(c * c for c in met) < members**2 / 3


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2**63, 3000, dtype=np.uint64), rng.integers(0, 2**63, 3000, dtype=np.uint64)
    b[:2700] = a[:2700]
    ra, rb = near_dedup.registers(a, 256), near_dedup.registers(b, 256)
    assert (np.maximum(ra, rb) == near_dedup.registers(np.unique(np.concatenate((a, b))), 256)).all()
    counts = [np.array([x]) for x in ((ra > rb).sum(), (ra < rb).sum(), (ra == rb).sum())]
    estimate, likely = near_dedup.likelihoods(*counts, np.array([3000.0]), np.array([3000.0]), 0.8)
    assert abs(estimate[0] - 2700 / 3300) < 0.12 and likely[0]


def test_odd_rows(odd, empty):
    got = {}
    for r in near_dedup.digest(odd).collect():
        got.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert len(got[1]) == 2 and {x[1] for x in got[1]} == {1} and got[2][0][1:] == (1, False)
    assert got[3] == [(0, 3, True)] and got[4] == [(0, 4, True)] and got[5] == [(0, 5, True)] and got[6] == [(1, 6, True)]
    assert sum(map(len, got.values())) == 13 and all(x[2] for x in got[None] if x[0] == 0)
    assert near_dedup.digest(empty).count() == 0 and near_dedup.filtered(empty).columns == empty.columns


def test_filtered_keeps_columns_and_one_of_each(odd):
    got = near_dedup.filtered(odd)
    assert got.columns == odd.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert 2 not in ids and 8 not in ids and ids.count(1) == 2 and {3, 4, 5, 6, 7, 9, 10} <= set(ids)


def test_rows_with_one_doc_id_and_different_texts(spark, prose):
    """However they are dealt, the same set stands for the id, and the rows of an id share its component."""
    rows = [(1, prose(60, 1)), (1, prose(60, 2)), (2, prose(60, 1) + " end"), (3, prose(60, 2) + " end"), (4, prose(60, 5)), (None, prose(60, 5))]
    found = []
    for parts in (1, 5):
        got = near_dedup.near_groups(spark.createDataFrame(rows[:: 1 if parts == 1 else -1], "doc_id long, text string").repartition(parts), 3, 80).collect()
        found.append(sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=repr))
    assert found[0] == found[1] and len(found[0]) == 6
    assert {r[2] for r in found[0] if r[0] == 1} == {1} and sorted(r[2] for r in found[0] if r[0] in (2, 3)) in ([1, 2], [1, 3])


def test_a_large_component_beside_a_few_others(spark, prose, monkeypatch):
    """Members beyond a block of the largest component, and others that only all pairs can join."""
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 8)
    monkeypatch.setattr(near_dedup, "MEMBERS_A_GROUP", 10)
    rng, texts, base = random.Random(6), {}, prose(100, 3).split()
    for d in range(90):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 5, 6])):
            words[rng.randrange(100)] = f"v{rng.randrange(40)}"
        texts[d] = " ".join(words)
    got = near_dedup.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 5, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == groups(texts, 5, 80)


def test_low_thresholds_have_as_many_registers_as_they_need(spark, prose):
    assert near_dedup.band_count(0.3) * near_dedup.ROWS > 4096
    times, plus = near_dedup.multipliers(9000)
    assert len({*times.tolist()}) == len(plus) == 9000 and (times % 2 == 1).all()
