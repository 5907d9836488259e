"""Packing of token sequences: shortest-pack-first over the length histogram.

Documents are tokenised, cut into pieces of at most ``max_length`` ids, and the histogram of piece lengths (at most
``max_length`` rows, whatever the corpus) is packed on the driver: lengths longest first, each put where the pack so far
is shortest, whole groups of equal packs at a time. The packs then meet the pieces again by (length, rank).

Ids are those of the `tokenizers` library and its file of the vocabulary.

Edge cases: a null or empty text is one piece holding the end id alone; repeated rows, and rows with one doc_id or none,
are pieces of their own (the key of a piece is given when it is written); an empty table gives an empty result; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import column_bytes, runs_of, text_column, written

MAX_LENGTH, END_ID = 2048, 1
#: Pieces of one length that one task ranks; words whose ids a task keeps.
RANKED_A_TASK, HELD_WORDS = 200_000, 500_000
PIECES = "doc_id long, start long, length int, ids binary, doc_tokens long"


class Words(dict):
    """Ids (little-endian unsigned 32-bit, as bytes) of words, by the model of a `tokenizers` vocabulary; each is encoded when first asked for."""

    def __init__(self, model, byte_level: dict[int, str]):
        super().__init__()
        self.model, self.byte_level = model, byte_level

    def __missing__(self, word: str) -> bytes:
        tokens = self.model.tokenize(word.encode().decode("latin-1").translate(self.byte_level))
        self[word] = ids = array("I", [t.id for t in tokens]).tobytes()
        return ids


class AfterBlank(dict):
    """Ids of what stands between a blank and the next, the blank before it included."""

    def __init__(self, words: Words, cut):
        super().__init__()
        self.words, self.cut = words, cut

    def __missing__(self, part: str) -> bytes:
        self[part] = ids = b"".join(map(self.words.__getitem__, self.cut(" " + part)))
        return ids


class Encoder:
    """Ids of texts (little-endian unsigned 32-bit, as bytes) by a byte-level BPE of the `tokenizers` library.

    The library's own way through a text costs about twice as much as cutting it by the vocabulary's pattern and
    asking the library's model for each distinct word; the ids are the same. A blank before something that is not white
    space always begins a word of the pattern, so a text without other blanks is cut there first, and each distinct part
    by the pattern once. A text that spells one of the vocabulary's added tokens goes through the library whole.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        # words first: no other alternative begins with a letter or a blank before one, and the order decides nothing
        kinds = public_tokenizers.PATTERN.split("|")
        self.cut = regex.compile("|".join(sorted(kinds, key=lambda k: "L}+" not in k))).findall
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.byte_level = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.known = Words(self.tokenizer.model, self.byte_level)
        self.parts = AfterBlank(self.known, self.cut)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd_blank = regex.compile(r" (?:\s|\Z)").search

    def __call__(self, text: str) -> bytes:
        for held in (self.known, self.parts):
            if len(held) > HELD_WORDS:
                held.clear()
        if any(content in text for content in self.added):  # such a token is found before the pattern cuts
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if self.odd_blank(text):
            return b"".join(map(self.known.__getitem__, self.cut(text)))
        first, *parts = text.split(" ")
        return b"".join([*map(self.known.__getitem__, self.cut(first)), *map(self.parts.__getitem__, parts)])


def token_pieces(docs: DataFrame, max_length: int = MAX_LENGTH, end_id: int = END_ID, vocabulary_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens. No shuffle."""
    end = np.uint32(end_id).astype("<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary_path)
        for batch in batches:
            _, offsets = column_bytes(batch.column("text"))
            doc_ids = batch.column("doc_id").to_pylist()
            for i, j in runs_of(offsets, 2_000_000):
                rows = []
                for doc_id, text in zip(doc_ids[i:j], batch.column("text").slice(i, j - i), strict=True):
                    raw = encode(text.as_py()) + end
                    n = len(raw) // 4
                    rows += [(doc_id, at, min(max_length, n - at), raw[4 * at : 4 * (at + max_length)], n) for at in range(0, n, max_length)]
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens"])

    return text_column(docs).mapInArrow(pieces, PIECES)


def shortest_pack_first(histogram: dict[int, int], max_length: int = MAX_LENGTH) -> list[tuple[int, list[int]]]:
    """Packs of a length histogram as (how many, lengths in order).

    Longest lengths first; of the open packs with room, the shortest takes the next piece. Packs with equal contents are
    counted, not listed, so the work and the result depend on max_length and not on the number of pieces: each length
    opens two new kinds of pack and splits one at most.
    """
    open_packs: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)  # by room left
    done: list[tuple[int, list[int]]] = []
    rooms: list[int] = []  # rooms with packs, ascending

    def put(count: int, lengths: list[int], room: int) -> None:
        if not room:
            done.append((count, lengths))
            return
        if not open_packs[room]:
            rooms.append(room)
        open_packs[room].append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fitting = [r for r in rooms if r >= length]
            if not fitting:
                fresh = max_length // length  # no open pack has room: as few new packs as hold what is left
                for packs, each in ((left // fresh, fresh), (1, left % fresh)):
                    if packs and each:
                        put(packs, [length] * each, max_length - length * each)
                break
            room = max(fitting)  # the shortest pack has the most room
            count, lengths = open_packs[room].pop()
            if not open_packs[room]:
                rooms.remove(room)
            used = min(count, left)
            put(used, [*lengths, length], room - length)
            if count > used:
                put(count - used, lengths, room)
            left -= used
    return done + [pack for packs in open_packs.values() for pack in packs]


def with_sequences(pieces: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length and any more light columns; ids are joined later).

    The histogram has at most max_length rows and the slots of its packs depend on max_length only, so both are safe on
    the driver and as broadcasts. Pieces of one length are ranked in parts of about RANKED_A_TASK, as many as the
    histogram asks for, so a length that a third of all pieces share is ranked by as many tasks as it needs.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken: dict[int, int] = defaultdict(int)
    slots, sequence = [], 0
    for count, lengths in shortest_pack_first(histogram, max_length):
        at = 0
        for length in lengths:
            slots.append((length, taken[length], taken[length] + count, sequence, at))
            taken[length] += count
            at += length
        sequence += count
    slot_table = F.broadcast(spark.createDataFrame(slots, "length int, _from long, _to long, _first long, offset long"))
    parts = F.broadcast(spark.createDataFrame([(length, -(-n // RANKED_A_TASK)) for length, n in histogram.items()], "length int, _parts int"))
    order = [F.col(c) for c in pieces.columns if c != "length"]
    salted = pieces.join(parts, "length").withColumn("_part", F.pmod(F.xxhash64(*order), F.col("_parts")).cast("int")).drop("_parts")
    ranked = salted.withColumn("_local", F.row_number().over(Window.partitionBy("length", "_part").orderBy(*order)) - 1)
    counts = salted.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for RANKED_A_TASK pieces, and max_length more
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    placed = ranked.join(before, ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_local"))
    joined = placed.join(slot_table, "length").where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return joined.select(*pieces.columns, (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"), F.col("offset"))


def placed_pieces(docs: DataFrame, max_length: int = MAX_LENGTH, end_id: int = END_ID, vocabulary_path: str | None = None) -> DataFrame:
    """Pieces with their ids and places: doc_id, start, length, doc_tokens, sequence_id, offset, ids."""
    tokens = written(token_pieces(docs, max_length, end_id, vocabulary_path).withColumn("key", F.monotonically_increasing_id()), "pieces")
    light = tokens.select("doc_id", "start", "length", "doc_tokens", F.crc32("ids").alias("crc"), "key")
    places = with_sequences(light, max_length).select("key", "sequence_id", "offset")
    return tokens.join(places, "key").select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")


def pack(docs: DataFrame, max_length: int = MAX_LENGTH, end_id: int = END_ID, vocabulary_path: str | None = None) -> DataFrame:
    """Packed sequences: sequence_id, n_tokens, ids (little-endian unsigned 32-bit, in order) and pieces (doc_id, start, length, offset)."""
    cells = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))  # max_length ids at most
    whole = placed_pieces(docs, max_length, end_id, vocabulary_path).groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), cells.alias("c"))
    ids = F.aggregate("c", F.lit(b""), lambda s, c: F.concat(s, c["ids"]))
    return whole.select("sequence_id", "n_tokens", ids.alias("ids"), F.transform("c", lambda c: F.struct(c["doc_id"].alias("doc_id"), c["start"].alias("start"), c["length"].alias("length"), c["offset"].alias("offset"))).alias("pieces"))


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: pieces with sequence and offset, and a checksum instead of the ids."""
    pieces = token_pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    placed = with_sequences(written(pieces, "pieces"))
    return placed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")
