"""The pipeline: each stage on its own input against a plain version of its promise."""

from __future__ import annotations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from larkspur.llm import decontamination, quality  # noqa: E402
from tests.llm.test_near_dedup import groups  # noqa: E402
from tests.llm.test_suffix_dedup import plain  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        f(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[1:-1])


def test_quality(spark, stages):
    judged = {r["doc_id"]: r["kept"] for r in quality.judged(stages[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert set(texts(stages[1])) == {d for d, k in judged.items() if k}


def test_near_dedup(stages):
    before = texts(stages[1])
    assert set(texts(stages[2])) == {d for d, (_, c) in groups(before, 5, 80).items() if d == c}


def test_suffix_dedup(stages):
    before, after = texts(stages[2]), texts(stages[3])
    removed = {d: p[1] for d, p in plain(before).items()}
    for d, t in before.items():
        if removed[d] == 0:
            assert after[d] == t
        elif d in after:
            assert len(t.encode()) - removed[d] >= len(after[d].encode()) >= len(t.encode()) - removed[d] - 6
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3].collect())


def test_decontamination(spark, stages):
    items = [decontamination.normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    after = texts(stages[4])
    assert not any(i in decontamination.normal(t) for t in after.values() for i in items)
    gone = set(texts(stages[3])) - set(after)
    assert gone == {r["doc_id"] for r in decontamination.leaks(stages[3], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}


def test_packing(stages):
    rows = stages[5].collect()
    assert {r["doc_id"] for r in rows} == set(texts(stages[4]))


def test_odd_rows_pass_all_stages(spark, odd, empty):
    """Nulls, empty and long texts, repeated rows, and columns named like the operators' own."""
    for docs in (odd, empty):
        rows = docs
        for name, f in corpus_pipeline.STAGES[:-1]:
            rows = f(spark, rows, SF)
            assert rows.columns == docs.columns, name
        before, after = docs.collect(), rows.collect()
        ids = {r["doc_id"] for r in before}
        assert all(r["doc_id"] in ids and r["_row"] == "x" for r in after)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert sum(r["start"] == 0 for r in packed) == len(before)
        assert all(len(r["ids"]) == 4 * r["length"] for r in packed)


def test_run(spark, stages):
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], bytes(r["ids"])) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[5])
