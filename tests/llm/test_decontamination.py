"""Edit matching against a full table of distances."""

from __future__ import annotations

import random

from larkspur.llm import decontamination as d


def best_distance(item, text):
    """Least edit distance of item to any part of text, with its first end."""
    row = list(range(len(item) + 1))
    best = (row[-1], 0)
    for j, c in enumerate(text, 1):
        last, row[0] = row[0], 0
        for i in range(1, len(row)):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (item[i - 1] != c))
        best = min(best, (row[-1], j))
    return best


def edited(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + "q" + text[i + 1 :], text[:i] + text[i + 1 :], text[:i] + "z" + text[i:]])
    return text


def test_against_all_distances(spark, prose):
    rng = random.Random(1)
    items = {i: prose(rng.randrange(6, 30), 50 + i) for i in range(8)}
    docs = {}
    for k in range(80):
        item = items[rng.randrange(8)]
        n = rng.randrange(0, d.budget(len(item)) + 4)
        docs[k] = f"{prose(rng.randrange(20), k)} {edited(rng, item, n).upper() if k % 3 == 0 else edited(rng, item, n)}\n {prose(rng.randrange(20), 300 + k)}"
    found = d.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in found.collect()}
    want = {}
    for k, t in docs.items():
        for i, x in items.items():
            distance, _ = best_distance(d.normal(x), d.normal(t))
            if distance <= d.budget(len(d.normal(x))):
                want[k, i] = distance
    assert got == want and len(want) > 30


def test_pieces_cover_the_item():
    for n in range(20, 90):
        cut = d.pieces("x" * n, d.budget(n))
        assert "".join(p for _, p in cut) == "x" * n and len(cut) == d.budget(n) + 1


def test_myers_against_the_table():
    rng = random.Random(2)
    for _ in range(200):
        item, text = ("".join(rng.choice("abc") for _ in range(rng.randrange(*r))) for r in ((1, 90), (0, 120)))
        distance, end = best_distance(item, text)
        assert d.myers(item, text, len(item)) in ((distance, end), None if distance == len(item) else (distance, end), (distance, 1))


def test_several_shards(spark, prose, monkeypatch):
    monkeypatch.setattr(d, "SHARD_BYTES", 200)
    items = spark.createDataFrame([(i, prose(9, i)) for i in range(12)], "item_id long, text string")
    docs = spark.createDataFrame([(i, prose(5, 90 + i) + " " + prose(9, i)) for i in range(12)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in d.leaks(docs, items).collect()) == [(i, i) for i in range(12)]


def test_odd_rows(spark, odd, empty, prose):
    items = spark.createDataFrame([(1, prose(40, 1), "x"), (1, prose(40, 1), "x"), (2, None, "x"), (3, "", "x"), (None, "some long enough text here", "x"), (4, "Word", "x")], "item_id long, text string, doc_id string")
    got = d.leaks(odd, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, 1) for i in (1, 2, None, 8, 10)} | {(6, 4)}
    kept = d.filtered(odd, items)
    assert kept.columns == odd.columns and {3, 4, 5, 7, 9} <= {r["doc_id"] for r in kept.collect()}
    assert d.leaks(empty, items).count() == 0 and d.leaks(odd, items.limit(0)).count() == 0


def test_short_items_as_whole_words(spark):
    items = spark.createDataFrame([(1, "What is pi?"), (2, "cat")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "So: what is  pi? 3.14"), (2, "concatenate"), (3, "the CAT sat"), (4, "what is pie?"), (5, "cat")], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in d.leaks(docs, items).collect()} == {(1, 1, 0), (3, 2, 0), (5, 2, 0)}
    assert sorted(r["doc_id"] for r in d.filtered(docs, items).collect()) == [2, 4]


def test_null_doc_id_is_removed_with_one_shard_or_several(spark, prose, monkeypatch):
    items = spark.createDataFrame([(i, prose(9, i)) for i in range(12)], "item_id long, text string")
    docs = spark.createDataFrame([(None, prose(9, 3), 1), (None, "clean", 2), (7, prose(9, 4), 3), (7, "clean too", 4), (8, None, 5)], "doc_id long, text string, found_id int")
    for size in (4_000_000, 200):
        monkeypatch.setattr(d, "SHARD_BYTES", size)
        assert sorted(r["found_id"] for r in d.filtered(docs, items).collect()) == [2, 4, 5]


def test_start_is_that_of_a_best_occurrence():
    rng = random.Random(5)
    for _ in range(100):
        item, text = ("".join(rng.choice("abc") for _ in range(rng.randrange(*r))) for r in ((1, 30), (1, 60)))
        found = d.myers(item, text, len(item))
        if found and found[0] < len(item):
            start = d.start_of(item, text, found[1], found[0])
            assert best_distance(text[start : found[1]], item)[0] <= found[0] == min(x for x in [list(d.distances(item, text[start : found[1]], True))[-1]])
