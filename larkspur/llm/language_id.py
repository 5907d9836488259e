"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over all
its segmentations into pieces, by a forward pass over its bytes, whatever its length: many short words at once in a
matrix, long ones (scripts without blanks) in logarithms with the values of the last longest-piece bytes. A text's is the
product over its words. Probabilities are learned by expectation-maximisation on a bounded sample of labelled texts
(SAMPLE_TEXTS whole texts per language, by hash of doc_id, whatever their length, of which the LEARNED_WORDS most frequent
words); there, words beyond SHORT_BYTES bytes are counted in parts, cut between characters. Prediction covers every whole text.

Edge cases: null text, or text without a letter, is `und` with score 0; ties go to the first language in order; no
labelled text at all gives `und`; repeated rows score alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import gram_hashes, runs_of

SAMPLE_TEXTS, LEARNED_WORDS, ROUNDS, SMOOTHING = 1500, 200_000, 4, 0.1
SHORT_BYTES, HELD_WORDS, HELD_BYTES, LIKELY_BITS = 32, 200_000, 16_000_000, 18
MARK = "▁"


class Vocabulary:
    """Pieces of the public vocabulary as hashes of their bytes; every single byte is a piece too."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        known = {bytes([b]) for b in range(256)}
        for i in range(model.get_piece_size()):
            if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i)):
                known.add(model.id_to_piece(i).encode())
        by_length: dict[int, list[bytes]] = {}
        for piece in known:
            by_length.setdefault(len(piece), []).append(piece)
        self.size, self.tables = 0, {}
        for length, pieces in sorted(by_length.items()):
            hashes = np.sort(gram_hashes(np.frombuffer(b"".join(pieces), np.uint8), length)[::length])
            likely = np.zeros(1 << LIKELY_BITS, bool)  # the upper bits of the hashes that there are: most others need no search
            likely[hashes >> np.uint64(64 - LIKELY_BITS)] = True
            self.tables[length] = (hashes, self.size, likely)
            self.size += len(pieces)

    def places(self, words: list[bytes]) -> Places:
        return Places(self, words)


class Places:
    """All pieces inside some words: of pieces of each length, where they begin and which they are. Words lie end to end."""

    def __init__(self, vocabulary: Vocabulary, words: list[bytes]):
        lengths = np.array([len(w) for w in words], np.int64)
        self.ends = np.cumsum(lengths)
        self.begins = self.ends - lengths
        self.lengths = lengths
        data = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), lengths)
        self.found = {}
        room = self.ends[word] - np.arange(len(data))
        for length, (hashes, first, likely) in vocabulary.tables.items():
            h = gram_hashes(data, length)
            start = np.flatnonzero(likely[h >> np.uint64(64 - LIKELY_BITS)] & (room[: len(h)] >= length))
            h = h[start]
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            same = hashes[at] == h
            self.found[length] = (start[same], first + at[same])

    def tables(self) -> dict[int, np.ndarray]:
        """For each length of a piece found, and each byte, the piece of that length that begins there, or -1."""
        out = {}
        for length, (start, piece) in self.found.items():
            if len(start):
                out[length] = np.full(int(self.ends[-1]), -1, np.int32)
                out[length][start] = piece
        return out

    def forward(self, chances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word the sum over its segmentations, by language; and the forward values at each byte. chances: pieces x languages. For words of few bytes."""
        tables = self.tables()
        n, most = len(self.lengths), int(self.lengths.max()) if len(self.lengths) else 0
        order = np.argsort(-self.lengths, kind="stable")
        alpha = np.zeros((n, most + 1, chances.shape[1]))
        alpha[:, 0] = 1
        padded = np.concatenate((chances, np.zeros((1, chances.shape[1]))))
        sorted_lengths = self.lengths[order]
        begins = self.begins[order]
        for t in range(1, most + 1):
            live = int(np.searchsorted(-sorted_lengths, -t, side="right"))
            for length, table in tables.items():
                if length > t:
                    break
                piece = table[begins[:live] + t - length]
                if (piece >= 0).any():
                    alpha[:live, t] += alpha[:live, t - length] * padded[piece]
        out = np.empty((n, chances.shape[1]))
        out[order] = alpha[np.arange(n), sorted_lengths]
        return out, alpha[np.argsort(order)]

    def log_forward(self, logs: np.ndarray) -> np.ndarray:
        """As forward, in logarithms, for words of any length: log probability of each word by language. logs: of chances."""
        longest = max((k for k, (start, _) in self.found.items() if len(start)), default=1)
        word_of = np.repeat(np.arange(len(self.lengths)), self.lengths)
        start = np.concatenate([x for x, _ in self.found.values()])
        piece = np.concatenate([x for _, x in self.found.values()])
        length = np.repeat(np.fromiter(self.found, np.int64), [len(x) for x, _ in self.found.values()])
        word = word_of[start]
        time = start + length - self.begins[word]
        order = np.lexsort((word, time))
        piece, length, word, time = piece[order], length[order], word[order], time[order]
        most = int(self.lengths.max())
        step = np.searchsorted(time, np.arange(1, most + 2))
        new = np.concatenate(([True], (time[1:] != time[:-1]) | (word[1:] != word[:-1])))
        first = np.flatnonzero(new)
        first_step = np.searchsorted(first, step)
        ring = np.full((longest + 1, len(self.lengths), logs.shape[1]), -np.inf)
        ring[0] = 0
        out = np.empty((len(self.lengths), logs.shape[1]))
        for t in range(1, most + 1):  # every single byte is a piece, so each word that is not over has one that ends here
            i, j = step[t - 1], step[t]
            heads = first[first_step[t - 1] : first_step[t]]
            words, starts = word[heads], heads - i
            way = ring[(t - length[i:j]) % (longest + 1), word[i:j]] + logs[piece[i:j]]
            best = np.maximum.reduceat(way, starts)
            value = best + np.log(np.add.reduceat(np.exp(way - np.repeat(best, np.diff(np.append(starts, j - i)), axis=0)), starts))
            ring[t % (longest + 1), words] = value
            over = self.lengths[words] == t
            out[words[over]] = value[over]
        return out

    def expected(self, chances: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces (one language) over all segmentations, words weighted."""
        total, alpha = self.forward(chances[:, None])
        tables = self.tables()
        n, most = len(self.lengths), alpha.shape[1] - 1
        beta = np.zeros((n, most + 1))
        beta[np.arange(n), self.lengths] = 1
        padded = np.append(chances, 0.0)
        counts = np.zeros(len(chances) + 1)
        scale = weights / np.maximum(total[:, 0], 1e-300)
        for t in range(most - 1, -1, -1):
            for length, table in tables.items():
                if length > most - t:
                    break
                rows = np.flatnonzero(self.lengths >= t + length)
                piece = table[self.begins[rows] + t]
                rows, piece = rows[piece >= 0], piece[piece >= 0]
                if len(rows):
                    part = padded[piece] * beta[rows, t + length]
                    beta[rows, t] += part
                    counts += np.bincount(piece, weights=alpha[rows, t, 0] * part * scale[rows], minlength=len(counts))
        return counts[:-1]


def words_of(text: str) -> list[str]:
    return text.lower().split()


def parts_of(word: str) -> list[bytes]:
    """A word with its mark, for learning: whole, or beyond SHORT_BYTES bytes in parts cut between characters."""
    raw = (MARK + word).encode()
    parts, at = [], 0
    while len(raw) - at > SHORT_BYTES:
        end = at + SHORT_BYTES
        while raw[end] & 0xC0 == 0x80:
            end -= 1
        parts.append(raw[at:end])
        at = end
    return [*parts, raw[at:]]


def learned(words: list[bytes], weights: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Piece probabilities of one language from words (parts_of) and their counts."""
    step = 50_000
    batches = [(vocabulary.places(words[i : i + step]), weights[i : i + step]) for i in range(0, len(words), step)]
    chances = np.full(vocabulary.size, 1.0 / vocabulary.size)
    for _ in range(ROUNDS):
        total = sum((p.expected(chances, w) for p, w in batches), np.zeros(vocabulary.size))
        chances = (total + SMOOTHING) / (total.sum() + SMOOTHING * vocabulary.size)
    return chances


def language_models(labelled: DataFrame, path: str | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors and log piece probabilities (pieces x languages) from (doc_id, text, lang); each language is learned in a task of its own from a bounded sample."""
    rows = labelled.where("text is not null and lang is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, SAMPLE_TEXTS / n))).otherwise(share)
    place = F.coalesce(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / (1 << 30), F.lit(0.0))
    sample = rows.where(place < share).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                words.setdefault(lang, Counter()).update(words_of(text.as_py()))
            found: Counter = Counter()
            for lang, counts in words.items():
                for word, n in counts.items():
                    for part in parts_of(word):
                        found[lang, part] += n
            langs, parts = zip(*found, strict=True) if found else ((), ())
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(parts, pa.binary()), pa.array(found.values(), pa.int64())], names=["lang", "part", "n"])

    counted = sample.mapInArrow(count, "lang string, part binary, n long").groupBy("lang", "part").agg(F.sum("n").alias("n"))

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "descending"), ("part", "ascending")]).slice(0, LEARNED_WORDS)
        chances = learned(table.column("part").to_pylist(), np.array(table.column("n").to_pylist(), np.float64), Vocabulary(path))
        return pa.table({"lang": [table.column("lang")[0].as_py()], "chances": pa.array([chances.astype(np.float64).tobytes()], pa.binary())})

    got = sorted((r["lang"], np.frombuffer(bytes(r["chances"]), np.float64)) for r in counted.groupBy("lang").applyInArrow(fit, "lang string, chances binary").collect())
    languages = [x for x, _ in got]
    total = sum(sizes[x] for x in languages)
    return languages, np.log([sizes[x] / total for x in languages]), np.stack([c for _, c in got], axis=1) if got else np.zeros((0, 0))


class Scorer:
    """Log probabilities of words by language; keeps those of frequent words."""

    def __init__(self, chances: np.ndarray, path: str | None):
        self.vocabulary, self.chances, self.logs = Vocabulary(path), chances, np.log(chances)
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.known, self.bytes = np.zeros((0, self.chances.shape[1])), 0

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.rows) > HELD_WORDS or self.bytes > HELD_BYTES:
            self.forget()
        fresh = [(w, (MARK + w).encode()) for w in {w for words in texts for w in words} - self.rows.keys()]
        short = [x for x in fresh if len(x[1]) <= SHORT_BYTES]
        long = sorted((x for x in fresh if len(x[1]) > SHORT_BYTES), key=lambda x: len(x[1]))
        got = [self.known]
        for i in range(0, len(short), 20_000):
            got.append(np.log(self.vocabulary.places([raw for _, raw in short[i : i + 20_000]]).forward(self.chances)[0]))
        sizes = np.concatenate(([0], np.cumsum([len(raw) for _, raw in long]))).astype(np.int64)
        for i, j in runs_of(sizes, 1_000_000):
            got.append(self.vocabulary.places([raw for _, raw in long[i:j]]).log_forward(self.logs))
        self.rows.update(zip([w for w, _ in short + long], range(len(self.known), len(self.known) + len(fresh)), strict=True))
        self.known = np.concatenate(got)
        self.bytes += int(sizes[-1])

    def totals(self, words: list[str]) -> np.ndarray:
        rows = self.rows
        return self.known[[rows[w] for w in words]].sum(axis=0) if words else np.zeros(self.known.shape[1])


def predictions(docs: DataFrame, labelled: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score (posterior of the language predicted)."""
    languages, priors, chances = language_models(labelled, path)
    sent = docs.sparkSession.sparkContext.broadcast((priors, chances))  # languages x vocabulary
    schema = "doc_id long, lang_pred string, score double"
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if not languages:
        return plain.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        priors, chances = sent.value
        scorer = Scorer(chances, path)
        for batch in batches:
            texts = [words_of(t.as_py()) if ok else [] for t, ok in zip(batch.column("text"), batch.column("letters").to_pylist(), strict=True)]
            scorer.learn(texts)
            names, scores = [], []
            for words, ok in zip(texts, batch.column("letters").to_pylist(), strict=True):
                if not ok:
                    names.append("und")
                    scores.append(0.0)
                    continue
                logs = scorer.totals(words) + priors
                best = int(logs.argmax())
                names.append(languages[best])
                scores.append(float(1 / np.exp(logs - logs[best]).sum()))
            yield pa.record_batch([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return plain.mapInArrow(predict, schema)


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: learned from documents outside the held-out quarter."""
    remainder = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)), F.lit(0))
    got = predictions(docs, docs.where(remainder != 2))
    return got.select("doc_id", (remainder == 2).alias("held_out"), "lang_pred", "score")
