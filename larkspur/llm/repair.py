"""Conversation structure repair as the shortest path of a weighted composition.

Three machines are composed lazily, state by state, and never written out: the acceptor of a conversation's rows, in order;
a transducer of edits (Keep, Rerole, Delete, Insert); and an acceptor of the role grammar `(s?(ua)+)?`, over the initials
of roles. The composition has no cycles besides insertions, so one pass in the order of the rows finds the shortest path
from and to each state of the grammar, over weights (cost, label string) compared as pairs, labels by ASCII.

The pass holds four paths at a time. Labels are compared by their rank among the four, which extensions keep: labels that
end with the same row are equal or differ before either ends. What the repaired conversation hashes to is carried along each
path, so texts are read once and none is held; four bytes a row remember the way back, about as much as the audit itself.

Spark finds repeated rows and rows seen earlier by grouping, whatever share of the table one conversation or one text
holds. A conversation's rows then pass through one task, sorted and streamed: its hash is sequential.

Edge cases: a null conv_id is a conversation of its own; nulls in any column count as one space where text is asked for
(hash of `conv_id:turn`, role, text), so a null text is blank and a null role has an initial that no grammar takes; an empty
role has no initial and cannot be kept; null turns come first; rows of one turn are in order of role and text; repeated
rows are repeats. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The role grammar `(s?(ua)+)?`: arcs by state and initial, and the states that accept.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
BLANKS = " \t\n\x0b\x0c\r"
DELETE, INSERT, KEEP, REROLE = "D", "I", "K", "R"
LETTERS = DELETE + KEEP + REROLE
REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


@dataclass
class Path:
    """The best path to a state of the grammar after some rows: its cost, its labels' rank among such paths, and the text it writes."""

    cost: int
    rank: int
    text: object
    empty: bool


class Repair:
    """The composed machine of one conversation, advanced row by row."""

    def __init__(self, costs: Costs):
        self.costs = costs
        self.paths = {0: Path(0, 0, sha256(), True)}
        self.back = bytearray()

    def closed(self) -> dict[int, tuple[int, int, str, int]]:
        """Each state that is reached by insertions alone: (cost, rank, inserted labels, state they begin at)."""
        reached = {state: (p.cost, p.rank, "", state) for state, p in self.paths.items()}
        again = True
        while again:
            again = False
            for state, (cost, rank, labels, origin) in list(reached.items()):
                for initial, to in GRAMMAR[state].items():
                    way = (cost + self.costs.insert, rank, labels + INSERT, origin)
                    if initial in ROLES and (to not in reached or way < reached[to]):
                        reached[to], again = way, True
        return reached

    def edits(self, initial: str, fault: str) -> Iterator[tuple[str, int, str]]:
        """The transducer's arcs that read a row: (label, cost, initial it writes; empty: none)."""
        yield DELETE, self.costs.delete, ""
        if fault in ("blank", "duplicate"):
            return
        more = self.costs.truncated if fault == "truncated" else 0
        if initial:
            yield KEEP, more, initial
        for other in ROLES:
            yield REROLE, self.costs.rerole + more, other

    def row(self, role: str, text: str, fault: str) -> None:
        """Composes one more row."""
        best: dict[int, tuple] = {}
        reached = self.closed()
        arcs = list(self.edits(role[:1], fault))
        for state, (cost, rank, labels, origin) in reached.items():
            for label, more, initial in arcs:
                to = GRAMMAR[state].get(initial) if initial else state
                if to is not None:
                    way = (cost + more, rank, labels + label, origin, initial)
                    if to not in best or way < best[to]:
                        best[to] = way
        order = {way[1:3]: n for n, way in enumerate(sorted(best.values(), key=lambda w: w[1:3]))}
        paths, places = {}, [255] * len(GRAMMAR)
        for to, (cost, rank, labels, origin, initial) in best.items():
            before = self.paths[origin]
            path = Path(cost, order[(rank, labels)], before.text.copy(), before.empty)
            inserted(path, origin, len(labels) - 1)
            if labels[-1] != DELETE:
                write(path, role if labels[-1] == KEEP else ROLES[initial], text)
            paths[to] = path
            places[to] = origin | (len(labels) - 1) << 2 | LETTERS.index(labels[-1]) << 4
        self.paths = paths
        self.back += bytes(places)

    def ended(self) -> tuple[int, str, str]:
        """(cost, audit, digest of the repaired conversation)."""
        cost, _, labels, state = min(way for state, way in self.closed().items() if state in FINAL)
        path = self.paths[state]
        inserted(path, state, len(labels))
        parts, width = [labels], len(GRAMMAR)
        for at in range(len(self.back) - width, -1, -width):
            place = self.back[at + state]
            parts += [LETTERS[place >> 4], INSERT * (place >> 2 & 3)]
            state = place & 3
        return cost, "".join(reversed(parts)), path.text.hexdigest()


def write(path: Path, role: str, text: str) -> None:
    path.text.update(f"{'' if path.empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
    path.empty = False


def inserted(path: Path, state: int, n: int) -> None:
    """Writes n inserted rows: each state has one arc with a role that may be inserted."""
    for _ in range(n):
        initial = next(i for i in GRAMMAR[state] if i in ROLES)
        write(path, ROLES[initial], "")
        state = GRAMMAR[state][initial]


def fault_of(text: str, first: bool) -> str:
    """The first fault of a row: blank, duplicate, truncated, or none."""
    said = text.rstrip(BLANKS)
    if not said:
        return "blank"
    if not first:
        return "duplicate"
    return "" if said[-1] in ".!?" else "truncated"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows damaged by the hash of `conv_id:turn`; n: how often (0: dropped)."""
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    h = F.crc32(F.concat(spaced["conv_id"], F.lit(":"), spaced["turn"])) % 20
    role = F.when(h == 4, "user").otherwise(spaced["role"])
    text = F.when(h == 1, "").when(h == 2, F.translate(spaced["text"], ".!?", "")).otherwise(spaced["text"])
    kept = h != 0
    n = F.when(h == 0, 0).when(h == 3, 2).otherwise(1).cast("long")
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.when(kept, F.col("turn").cast("long")).alias("turn"), F.when(kept, role).alias("role"), F.when(kept, text).alias("text"), n.alias("n")
    )


def with_firsts(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number n, and whether no earlier row of the conversation has its role and text."""
    key = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("_key", key)
    firsts = once.where("n > 0").groupBy(F.col("conv_id").alias("_conv"), F.col("_key").alias("_same")).agg(F.min(F.struct("turn")).alias("_first"))
    joined = once.join(firsts, once["conv_id"].eqNullSafe(firsts["_conv"]) & (once["_key"] == firsts["_same"]), "left")
    return joined.select("conv_id", "turn", "role", "text", "n", F.col("turn").eqNullSafe(F.col("_first.turn")).alias("first"))


def repairs(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Per conversation of (conv_id, turn, role, text, n): its faults, the cost and labels of its cheapest repair, and the digest of what that writes."""
    ordered = with_firsts(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for conv, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "first")), strict=True):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        out.append(now.result())
                    now = Conversation(conv, costs)
                now.add(*row)
            if len(out) >= 1000:
                yield table_of(out)
                out = []
        if now is not None:
            out.append(now.result())
        yield table_of(out)

    return ordered.mapInArrow(stream, REPAIRED)


class Conversation:
    """Counts of one conversation's rows, as they come in order, and their repair."""

    def __init__(self, conv_id: int | None, costs: Costs):
        self.conv_id = conv_id
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        self.first_turn, self.last_turn, self.turns, self.illegal, self.before = None, None, 0, 0, None
        self.repair = Repair(costs)

    def add(self, turn: int | None, role: str | None, text: str | None, n: int, first: bool) -> None:
        for i in range(n):
            fault = fault_of(text, first and i == 0)
            self.faults[fault] += 1
            if self.before is not None and self.before + role[:1] not in LEGAL:
                self.illegal += 1
            self.before = role[:1]
            self.repair.row(role, text, fault)
        if n and turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn, self.turns = turn, self.turns + 1

    def result(self) -> tuple:
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.illegal, *self.repair.ended())


def table_of(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in REPAIRED.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 9, kinds, strict=True)], names=names)


def repaired_turns(conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """The repaired conversations: (conv_id, place, turn, role, text, edit), place from 1; turn is null for inserted rows, deleted rows are gone."""
    plain = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(1).cast("long").alias("n")
    )
    each = Window.partitionBy("conv_id").orderBy("p")
    labels = repairs(plain, costs).select("conv_id", F.posexplode(F.split("audit", "")).alias("p", "edit")).where("edit != ''")
    labels = labels.withColumn("i", F.sum((F.col("edit") != INSERT).cast("int")).over(each)).where(F.col("edit") != DELETE)
    rows = plain.withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")))
    met = labels.alias("l").join(rows.alias("r"), F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l.i") == F.col("r.i")) & (F.col("l.edit") != INSERT), "left")
    found = met.select("l.conv_id", "l.p", "l.edit", "r.turn", "r.role", F.coalesce("r.text", F.lit("")).alias("text")).withColumn("place", F.row_number().over(each))
    system = F.max(((F.col("place") == 1) & (F.col("edit") == KEEP) & F.col("role").startswith("s")).cast("int")).over(Window.partitionBy("conv_id"))
    role = F.when(F.col("edit") == KEEP, F.col("role")).otherwise(F.when((F.col("place") - system) % 2 == 1, ROLES["u"]).otherwise(ROLES["a"]))
    return found.select("conv_id", F.col("place").cast("long").alias("place"), "turn", role.alias("role"), "text", "edit")


def digest(conversations: DataFrame) -> DataFrame:
    """The query's columns: every conversation, damaged and repaired."""
    return repairs(damaged(conversations))


def _plus(weight: str, cost: int | str, labels: str) -> str:
    """SQL: a weight (twelve digits of cost, then labels) extended by an arc."""
    return f"lpad(CAST(CAST(left({weight}, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({weight}, 13) || '{labels}'"


_C = Costs()
_UNSAID = "[^\\x20\\x09-\\x0D]"
ORACLE_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    row_number() OVER () AS u
  FROM (SELECT *, unnest(CASE h WHEN 0 THEN CAST([] AS INTEGER[]) WHEN 3 THEN [1, 2] ELSE [1] END) AS n FROM hashed)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, u) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, u) AS seen,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, u) || left(role, 1) AS pair
  FROM damaged
), judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '{_UNSAID}') THEN 'b' WHEN seen > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '' END AS fault
  FROM numbered
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM judged GROUP BY conv_id
), paths AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, repeat('0', 12) AS w0, CAST(NULL AS VARCHAR) AS w1, CAST(NULL AS VARCHAR) AS w2, CAST(NULL AS VARCHAR) AS w3 FROM counted
  UNION ALL
  SELECT conv_id, i, {_plus("w0", _C.delete, DELETE)},
    least({_plus("w1", _C.delete, DELETE)}, CASE WHEN stays AND initial = 's' THEN {_plus("w0", "late", KEEP)} END),
    least({_plus("v2", _C.delete, DELETE)}, CASE WHEN stays AND initial = 'u' THEN {_plus("least(w0, w1, v3)", "late", KEEP)} END, CASE WHEN stays THEN {_plus("least(w0, w1, v3)", f"late + {_C.rerole}", REROLE)} END),
    least({_plus("v3", _C.delete, DELETE)}, CASE WHEN stays AND initial = 'a' THEN {_plus("v2", "late", KEEP)} END, CASE WHEN stays THEN {_plus("v2", f"late + {_C.rerole}", REROLE)} END)
  FROM (
    SELECT *, least(w3, {_plus("v2", _C.insert, INSERT)}) AS v3 FROM (
      SELECT p.conv_id, j.i, left(j.role, 1) AS initial, j.fault NOT IN ('b', 'd') AS stays, CASE j.fault WHEN 't' THEN {_C.truncated} ELSE 0 END AS late, w0, w1, w3,
        least(w2, {_plus("least(w0, w1, w3)", _C.insert, INSERT)}) AS v2
      FROM paths p JOIN judged j ON p.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = p.i + 1))
), ended AS (
  SELECT c.*, least(w0, w3, {_plus(f"least(w2, {_plus('least(w0, w1)', _C.insert, INSERT)})", _C.insert, INSERT)}) AS w
  FROM paths p JOIN counted c ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.i = c.n
), labelled AS (
  SELECT conv_id, p, substr(w, CAST(12 + p AS BIGINT), 1) AS edit FROM (SELECT conv_id, w, unnest(range(1, length(w) - 11)) AS p FROM ended)
), walked AS (
  SELECT *, sum(CASE WHEN edit = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY p) AS i,
    sum(CASE WHEN edit = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY p) AS place
  FROM labelled
), met AS (
  SELECT k.*, j.role, j.text, max(CASE WHEN place = 1 AND edit = 'K' AND left(j.role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY k.conv_id) AS led
  FROM walked k LEFT JOIN judged j ON k.conv_id IS NOT DISTINCT FROM j.conv_id AND k.i = j.i AND k.edit <> 'I'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS whole
  FROM met WHERE edit <> 'D' GROUP BY conv_id
)
SELECT CAST(o.conv_id AS BIGINT) AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(CAST(left(w, 12) AS BIGINT), 0) AS cost, coalesce(substr(w, 13), '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN repaired r ON o.conv_id IS NOT DISTINCT FROM r.conv_id
"""
