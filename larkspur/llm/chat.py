"""Chat formatting by incremental black-box rendering.

A template is any function from messages (role, text) to one string. It is rendered for each prefix of a conversation's
turns; where the output of a prefix begins with that of the prefix before, the rest is the turn's span. A probe text in
place of the turn's own tells how much of the span is the template's, before and after the text. Assistant texts so
located form the loss mask. A template whose later outputs change what came before, or whose marks depend on the text,
is reported (``rewrites``: the first such turn), and that conversation gets no mask.

The template given, ``marked``, marks turns and escapes its control strings inside texts with a backslash; ``parsed``
reads a formatted conversation back.

Edge cases: rows are ordered by turn, then role and text (nulls first); a null role or text is empty; a null conv_id is a
conversation of its own; repeated rows are turns of their own; an empty table gives an empty result; other columns are
ignored. A conversation is one row of the result, so one task holds it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Message = tuple[str, str]
Template = Callable[[list[Message]], str]
PROBE = "\uE000"
FORMATTED = "conv_id long, formatted string, loss array<struct<start:long,end:long>>, rewrites int"

#: Control strings of the template `marked`.
CONTROLS = ("[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[TEXT]", "<s>", "</s>")
_ESCAPED = re.compile("|".join([r"\\", *map(re.escape, CONTROLS)]))
_UNESCAPED = re.compile(r"\\(.)", re.S)
_TOKENS = re.compile(r"\\.|" + "|".join(map(re.escape, CONTROLS)), re.S)


def escaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text)


def marked(messages: list[Message]) -> str:
    """`<s>`, then each turn: user `[INST] text [/INST]`, assistant ` text</s>`, system `[SYS] text [/SYS]`, others `[ROLE] role[TEXT] text [/ROLE]`."""
    return "<s>" + "".join(map(marked_turn, messages))


def marked_turn(message: Message) -> str:
    role, text = message
    if role == "user":
        return f"[INST] {escaped(text)} [/INST]"
    if role == "assistant":
        return f" {escaped(text)}</s>"
    if role == "system":
        return f"[SYS] {escaped(text)} [/SYS]"
    return f"[ROLE] {escaped(role)}[TEXT] {escaped(text)} [/ROLE]"


def parsed(formatted: str) -> list[Message]:
    """The turns of a conversation formatted by `marked`."""
    marks = [(m.start(), m.end(), m[0]) for m in _TOKENS.finditer(formatted) if m[0][0] != "\\"]
    if not marks or marks[0][:2] != (0, 3) or marks[0][2] != "<s>":
        raise ValueError("no formatted conversation")
    turns, at, i = [], 3, 1
    while at < len(formatted):
        begin, end, mark = marks[i]
        if mark == "</s>" and formatted[at] == " ":
            turns.append(("assistant", unescaped(formatted[at + 1 : begin])))
            i += 1
        elif begin == at and mark in ("[INST]", "[SYS]") and marks[i + 1][2] == mark.replace("[", "[/"):
            turns.append(("user" if mark == "[INST]" else "system", unescaped(formatted[end + 1 : marks[i + 1][0] - 1])))
            i += 2
        elif begin == at and mark == "[ROLE]" and [m[2] for m in marks[i + 1 : i + 3]] == ["[TEXT]", "[/ROLE]"]:
            turns.append((unescaped(formatted[end + 1 : marks[i + 1][0]]), unescaped(formatted[marks[i + 1][1] + 1 : marks[i + 2][0] - 1])))
            i += 3
        else:
            raise ValueError(f"unexpected {mark} at {begin}")
        at = marks[i - 1][1]
    return turns


def rendered(messages: list[Message], template: Template, learn: str = "assistant") -> tuple[str, list[tuple[int, int]], int | None]:
    """The output for all messages, the spans of the texts of role `learn` in it, and the first turn that rewrites history (None: none)."""
    before, spans = template([]), []
    for i, (role, text) in enumerate(messages):
        now = template(messages[: i + 1])
        if not now.startswith(before):
            return template(messages), [], i
        if role == learn:
            probe = template([*messages[:i], (role, PROBE)])
            at = probe.rfind(PROBE)
            tail = len(probe) - at - len(PROBE)
            if at < len(before) or now[:at] != probe[:at] or now[len(now) - tail :] != probe[len(probe) - tail :]:
                return template(messages), [], i
            spans.append((at, len(now) - tail))
        before = now
    return before, spans, None


def formatted(conversations: DataFrame, template: Template = marked, learn: str = "assistant") -> DataFrame:
    """Per conversation: conv_id, formatted text, loss spans (code points of it), rewrites."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    columns = grouped.select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [rendered(list(zip(roles, texts, strict=True)), template, learn) for roles, texts in zip(batch.column("roles").to_pylist(), batch.column("texts").to_pylist(), strict=True)]
            spans = pa.array([[{"start": a, "end": b} for a, b in r[1]] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.record_batch([batch.column("conv_id"), pa.array([r[0] for r in rows], pa.string()), spans, pa.array([r[2] for r in rows], pa.int32())], names=["conv_id", "formatted", "loss", "rewrites"])

    return columns.mapInArrow(render, FORMATTED)


def read_back(rows: DataFrame) -> DataFrame:
    """Of formatted conversations (template `marked`), from their output alone: n_turns, digest of the turns, text under the loss mask and its digest, length."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            out = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                turns = parsed(text)
                learned = "".join(unescaped(text[s["start"] : s["end"]]) for s in spans)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                out.append((len(turns), sha256(whole.encode()).hexdigest(), len(learned), sha256(learned.encode()).hexdigest(), len(text)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.record_batch([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return rows.select("conv_id", "formatted", "loss").mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The conversation that holds the template's own control strings.
TRAP = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def digest(conversations: DataFrame) -> DataFrame:
    """The query's columns, for all conversations and the trap."""
    trap = conversations.sparkSession.createDataFrame(TRAP, "conv_id long, turn long, role string, text string")
    plain = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return read_back(formatted(plain.unionByName(trap)))


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for control in CONTROLS:
        out = f"replace({out}, '{control}', '\\{control}')"
    return out


ORACLE_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(length({_escaped_sql("text")}) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 WHEN 'system' THEN 13
    ELSE length({_escaped_sql("role")}) + 22 END) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
