"""Nearest neighbours against brute force: recall, exact scores, ties, copies and odd rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from larkspur.llm import nearest

SCHEMA = "vec_id long, embedding array<float>, label int, id string, block string, code string"


def frame(spark, ids, vectors):
    return spark.createDataFrame([(int(i) if i is not None else None, None if v is None else [None if x is None else float(x) for x in v], 1, "x", "y", "z") for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def brute(ids, vectors, k=20, every=20):
    """query -> [(vec_id, score)], nearest first."""
    v = np.asarray(vectors, np.float32).astype(np.float64)
    out = {}
    for i in np.flatnonzero(np.asarray(ids) % every == 0):
        score = v @ v[i]
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out[ids[i]] = [(ids[j], score[j]) for j in order]
    return out


def answers(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(got.setdefault(r["query_id"], [])) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got


def recall(got, want):
    return np.mean([len({j for j, _ in got.get(i, [])} & {j for j, _ in w}) / len(w) for i, w in want.items()])


@pytest.fixture(scope="module")
def drawn():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 24))
    unit = centres[rng.integers(0, 20, 3000)] * 0.5 + rng.normal(size=(3000, 24))
    return np.arange(3000) * 3 + 1000, unit / np.linalg.norm(unit, axis=1)[:, None]


def test_recall_and_scores_of_unit_vectors(spark, drawn):
    ids, vectors = drawn
    got, want = answers(nearest.digest(frame(spark, ids, vectors))), brute(ids, vectors)
    assert set(got) == set(want) and all(len(g) == 20 for g in got.values())
    assert recall(got, want) >= 0.95
    scores = {(i, j): s for i, w in brute(ids, vectors, 3000).items() for j, s in w}
    assert all(math.isclose(s, scores[i, j], rel_tol=1e-12, abs_tol=1e-15) for i, g in got.items() for j, s in g)
    assert all(g == sorted(g, key=lambda x: (-x[1], x[0])) for g in got.values())


def test_recall_of_vectors_of_any_length(spark, drawn):
    ids, vectors = drawn
    longer = vectors * np.random.default_rng(5).lognormal(0, 0.7, (len(ids), 1))
    assert recall(answers(nearest.digest(frame(spark, ids, longer))), brute(ids, longer)) >= 0.9


def test_few_rows_copies_and_ties_are_exact(spark):
    rng = np.random.default_rng(6)
    base = np.round(rng.normal(size=(12, 4)), 1)
    vectors = np.concatenate([base, np.repeat(base[:1], 45, axis=0), np.repeat(base[3:4], 30, axis=0), -base[:1]])
    ids = np.random.default_rng(7).permutation(len(vectors)) * 5
    got, want = answers(nearest.digest(frame(spark, ids, vectors))), brute(ids, vectors)
    assert {i: [j for j, _ in g] for i, g in got.items()} == {i: [j for j, _ in w] for i, w in want.items()}


def test_odd_rows(spark):
    good = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [-0.0, 2.0]), (40, [1.0]), (7, [1.0, 0.0])]
    odd = [(60, None), (80, []), (100, [0.0, -0.0]), (120, [1.0, None]), (140, [float("nan"), 1.0]), (160, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [1.0, 0.0]), (20, [0.5, 0.75])]
    rows = [*good, *odd]
    got = answers(nearest.digest(frame(spark, [r[0] for r in rows], [r[1] for r in rows])))
    assert got == {0: [(7, 1.0), (40, 1.0), (20, 0.5), (3, 0.0)], 20: [(3, 1.0), (0, 0.5), (7, 0.5), (40, 0.5)], 40: [(0, 1.0), (7, 1.0), (20, 0.5), (3, 0.0)]}


def test_empty_table_and_one_row(spark):
    assert nearest.digest(frame(spark, [], [])).collect() == []
    assert nearest.digest(frame(spark, [20], [[1.0, 2.0]])).collect() == []


def test_lists_keep_the_best_once():
    rows, others, sims, flags = (np.array(x) for x in ([0, 0, 0, 1, 0], [5, 6, 5, 5, 7], [0.5, 0.9, 0.5, 0.1, 0.9], [1, 1, 0, 1, 1]))
    got = nearest.best(rows, others, sims.astype(np.float32), flags.astype(np.uint8), 2)
    assert pd.DataFrame(dict(zip("roff", got, strict=False))).shape[0] == 3
    assert [x.tolist() for x in (got[0], got[1], got[3])] == [[0, 0, 1], [6, 7, 5], [1, 1, 1]]
