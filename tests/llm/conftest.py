from __future__ import annotations

import random

import pytest

CLASHING = "row string, block string, id string, n string, band string, bucket string, kept string, digest string, component string, _row string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def filled(*rows):
    return [(*r, *["x"] * 10) for r in rows]


@pytest.fixture(scope="session")
def prose():
    """prose(n, seed): n words of a small invented vocabulary."""

    def make(n, seed, size=400):
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(size)}{'abcdefgh'[rng.randrange(8)]}" for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd(spark, prose):
    """Null ids, texts, languages; empty, blank, one-word and long texts; repeated rows; clashing columns."""
    text = prose(80, 1)
    rows = filled(
        (1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, "en", "a", 1), (3, None, None, None, None), (4, "", "fr", "a", 0), (5, " \n\t ", "fr", "b", 3), (6, "Word", "fr", "b", 4), (7, prose(20_000, 2), "en", "b", 9),
        (None, text, "en", "a", 1), (8, text + " end", "en", "c", 2), (9, "Été déjà vu " * 30, "fr", "c", 2), (10, prose(60, 3) + " " + text, "en", "c", 2), (None, None, None, None, None),
    )
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
