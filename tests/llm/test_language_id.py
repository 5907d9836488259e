"""Language identification: the forward pass against listed segmentations, and held-out accuracy."""

from __future__ import annotations

import random

import numpy as np
import pytest

from larkspur.llm import language_id


@pytest.fixture(scope="module")
def vocabulary():
    return language_id.Vocabulary()


def pieces(vocabulary, word):
    """(piece number of word[a:b]) for all parts that are pieces."""
    tables = vocabulary.places([word]).tables()
    return {(a, a + n): int(table[a]) for n, table in tables.items() for a in range(len(word)) if table[a] >= 0}


def test_forward_sums_all_segmentations(vocabulary):
    rng = np.random.default_rng(1)
    chances = rng.random((vocabulary.size, 3)) / vocabulary.size
    words = [language_id.parts_of(w)[0] for w in ("the", "été", "schön", "a", "zzqx")]
    got, _ = vocabulary.places(words).forward(chances)
    for w, g in zip(words, got, strict=True):
        known = pieces(vocabulary, w)

        def total(a, w=w, known=known):
            return np.ones(3) if a == len(w) else sum((chances[known[a, b]] * total(b) for b in range(a + 1, len(w) + 1) if (a, b) in known), np.zeros(3))

        assert g == pytest.approx(total(0))


def test_words_of_any_length_are_summed_whole(vocabulary):
    """Against a plain sum in exact logarithms, beyond any part's length and with the longest pieces of the vocabulary."""
    rng = np.random.default_rng(5)
    chances = rng.random((vocabulary.size, 2)) * 1e-7
    words = [("▁" + w).encode() for w in ("中文没有空格" * 40, "x" * 90, "a" * 33, "internationalisation" * 9, "=" * 70, "é" * 400)]
    got = vocabulary.places(words).log_forward(np.log(chances))
    for w, g in zip(words, got, strict=True):
        known = pieces(vocabulary, w)
        assert max(b - a for a, b in known) <= max(vocabulary.tables)
        logs = np.full((len(w) + 1, 2), -np.inf)
        logs[0] = 0
        ends = {}
        for (a, b), piece in known.items():
            ends.setdefault(b, []).append((a, piece))
        for t in range(1, len(w) + 1):
            logs[t] = np.logaddexp.reduce([logs[a] + np.log(chances[piece]) for a, piece in ends[t]], axis=0)
        assert g == pytest.approx(logs[-1])
    short = [b"\xe2\x96\x81the", b"\xe2\x96\x81schoen"]
    assert vocabulary.places(short).log_forward(np.log(chances)) == pytest.approx(np.log(vocabulary.places(short).forward(chances)[0]))
    assert max(vocabulary.tables) == 48


def test_parts_for_learning_are_cut_between_characters():
    for word in ("中文没有空格" * 30, "é" * 99, "short", "x" * 31, "x" * 29):
        parts = language_id.parts_of(word)
        assert b"".join(parts) == ("▁" + word).encode() and all(p.decode() for p in parts) and max(map(len, parts)) <= language_id.SHORT_BYTES


def test_languages_of_long_texts_alone_are_learned(spark):
    rng = random.Random(8)
    words = {"en": "the and that with this from".split(), "fr": "le la les des est dans".split()}
    texts = [(i, " ".join(rng.choice(words[lang]) for _ in range(20_000)), lang) for i, lang in enumerate(rng.choices(list(words), k=16))]
    assert min(len(t) for _, t, _ in texts) > 64_000
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.digest(spark.createDataFrame(texts, "doc_id long, text string, lang string")).collect()}
    assert got == {i: lang for i, _, lang in texts}


def test_query_against_a_plain_version(spark, vocabulary):
    """The whole query on a small table: learning, sums over segmentations and posteriors by loops."""
    import math
    import zlib
    from collections import Counter

    rng = random.Random(11)
    stems = {"en": "the and that with".split(), "fr": "le la été dans".split()}
    rows = [(i, " ".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 5))), lang) for i, lang in enumerate(rng.choices(list(stems), k=40))]
    got = {r["doc_id"]: r for r in language_id.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    learn = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    models, priors = {}, Counter(lang for *_, lang in learn)
    for lang in sorted(stems):
        counts = Counter(w for _, t, x in learn if x == lang for w in t.split())
        chances = np.full(vocabulary.size, 1.0 / vocabulary.size)
        for _ in range(language_id.ROUNDS):
            total = np.zeros(vocabulary.size)
            for w, n in counts.items():
                raw = ("▁" + w).encode()
                known, paths = pieces(vocabulary, raw), []

                def walk(a, path, p, raw=raw, known=known, paths=paths, chances=chances):
                    if a == len(raw):
                        paths.append((path, p))
                    for b in range(a + 1, len(raw) + 1):
                        if (a, b) in known:
                            walk(b, [*path, known[a, b]], p * chances[known[a, b]])

                walk(0, [], 1.0)
                whole = sum(p for _, p in paths)
                for path, p in paths:
                    np.add.at(total, path, n * p / whole)
            chances = (total + language_id.SMOOTHING) / (total.sum() + language_id.SMOOTHING * vocabulary.size)
        models[lang] = chances

    def log_word(w, chances):
        raw = ("▁" + w).encode()
        known, alpha = pieces(vocabulary, raw), [1.0] + [0.0] * len(raw)
        for t in range(1, len(raw) + 1):
            alpha[t] = sum(alpha[a] * chances[p] for (a, b), p in known.items() if b == t)
        return math.log(alpha[-1])

    for d, t, _ in rows:
        logs = {x: math.log(priors[x] / len(learn)) + sum(log_word(w, c) for w in t.split()) for x, c in models.items()}
        best = max(sorted(logs), key=logs.get)
        assert got[d]["lang_pred"] == best and got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert got[d]["score"] == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs.values()))


def test_expected_counts_are_those_of_the_posterior(vocabulary):
    rng = np.random.default_rng(2)
    chances = rng.random(vocabulary.size) / vocabulary.size
    word = language_id.parts_of("the")[0]
    known, want = pieces(vocabulary, word), np.zeros(vocabulary.size)

    def walk(a, path, p):
        if a == len(word):
            paths.append((path, p))
        for b in range(a + 1, len(word) + 1):
            if (a, b) in known:
                walk(b, [*path, known[a, b]], p * chances[known[a, b]])

    paths = []
    walk(0, [], 1.0)
    whole = sum(p for _, p in paths)
    for path, p in paths:
        for piece in path:
            want[piece] += 2.5 * p / whole
    assert vocabulary.places([word]).expected(chances, np.array([2.5])) == pytest.approx(want)


def test_held_out_accuracy(spark):
    rng = random.Random(3)
    words = {"en": "the and that with this from have which their would".split(), "fr": "le la les des est dans pour que une avec été".split(), "de": "der die und das nicht ist mit für auf über".split()}
    texts = [(i, " ".join(rng.choice(words[lang]) for _ in range(12)).capitalize(), lang) for i, lang in enumerate(rng.choices(list(words), k=300))]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.digest(df).collect()}
    held = [i for i, *_ in texts if got[i]["held_out"]]
    assert len(held) > 40 and np.mean([got[i]["lang_pred"] == texts[i][2] for i in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_odd_rows(odd, empty):
    got = {}
    for r in language_id.digest(odd).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == 13
    assert [got[d][0]["lang_pred"] for d in (3, 4, 5)] == ["und"] * 3 and got[3][0]["score"] == 0
    assert got[1][0]["lang_pred"] == got[1][1]["lang_pred"] != "und"
    assert language_id.digest(empty).count() == 0


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "hello", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in language_id.digest(df).collect()] == [("und", 0.0)]
