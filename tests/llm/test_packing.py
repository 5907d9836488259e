"""Packing: exact round trip against the reference tokenizer, and the packer on histograms."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from larkspur.llm import packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20))
def test_packs_hold_the_histogram(histogram):
    packs = packing.shortest_pack_first(histogram, 64)
    held = Counter()
    for count, lengths in packs:
        assert count > 0 and sum(lengths) <= 64
        held.update({n: count * k for n, k in Counter(lengths).items()})
    assert held == histogram


def plain_packs(histogram, most):
    """One piece at a time, longest first, into the shortest pack with room."""
    packs = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fitting = [p for p in packs if sum(p) + length <= most]
            if fitting:
                min(fitting, key=sum).append(length)
            else:
                packs.append([length])
    return packs


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 12), max_size=10))
def test_packs_as_one_piece_at_a_time(histogram):
    """As many packs, filled alike: which of equally short packs takes a piece is all that may differ."""
    fills = Counter()
    for count, lengths in packing.shortest_pack_first(histogram, 64):
        fills[sum(lengths)] += count
    assert fills == Counter(sum(p) for p in plain_packs(histogram, 64))


ODD_TEXT = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u2003\u3000'sStTlLéß5٣²漢👍\u0301-")), max_size=60)


@settings(max_examples=400, deadline=None)
@given(st.lists(ODD_TEXT, max_size=4))
def test_ids_are_those_of_the_whole_text(texts):
    encode = packing.Encoder()
    whole = [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(encode(t), "<u4").tolist() for t in texts] == whole


def test_rows_with_one_doc_id_or_none(spark, prose):
    rows = [(5, prose(30, 1)), (5, prose(3, 2)), (None, prose(40, 3)), (None, "a"), (5, prose(3, 2))]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    encode = packing.Encoder()
    held = Counter()
    for r in got:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["n_tokens"] == sum(p["length"] for p in r["pieces"])
        held.update((p["doc_id"], ids[p["offset"] : p["offset"] + p["length"]].tobytes()) for p in r["pieces"])
    assert held == Counter((d, encode(t) + np.uint32(1).tobytes()) for d, t in rows)
    assert packing.digest(spark.createDataFrame(rows, "doc_id long, text string")).count() == 5


def test_lengths_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_A_TASK", 3)
    got = packing.digest(spark.createDataFrame([(i, "a b") for i in range(50)], "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(50)) and len({(r["sequence_id"], r["offset"]) for r in got}) == 50


def test_round_trip(spark, odd, prose):
    df = odd.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: [*reference.encode(t, add_special_tokens=False).ids, 1] for d, t in texts.items()}
    rows = packing.digest(df).collect()
    at = Counter()
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(want[r["doc_id"]])
        piece = np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert zlib.crc32(piece) == r["ids_crc32"]
        at[r["doc_id"]] += r["length"]
    assert at == {d: len(ids) for d, ids in want.items()}
    ends = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 2048 and len(ends) <= 1.1 * sum(ends.values()) / 2048 + 2
    packed = packing.pack(df)
    assert packed.count() == len(ends) and packed.agg({"n_tokens": "sum"}).first()[0] == sum(at.values())


def test_odd_rows(odd, empty):
    rows = packing.digest(odd).collect()
    assert sum(r["start"] == 0 for r in rows) == 13
    assert {r["length"] for r in rows if r["doc_id"] in (3, 4)} == {1}
    assert packing.digest(empty).count() == 0


def test_added_tokens_of_the_vocabulary():
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.Encoder()
    for text in ("<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>", "<|endoftext|> y", "< |endoftext|>", "<|endoftext|", "été <|endoftext|>\n\nend"):
        assert np.frombuffer(encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text
    assert np.frombuffer(encode("<|endoftext|>"), "<u4").tolist() == [50256]
