"""Chat formatting: exact round trips, black-box spans, templates that rewrite history."""

from __future__ import annotations

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import chat

PIECES = st.sampled_from([*chat.CONTROLS, "\\", "[", "<", "]", "/", " ", "a", "\n", "é", "INST]", "s>"])
TEXT = st.lists(PIECES, max_size=8).map("".join)
ROLE = st.one_of(st.sampled_from(["user", "assistant", "system"]), TEXT)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), max_size=6))
def test_round_trip_and_mask(messages):
    out, spans, rewrites = chat.rendered(messages, chat.marked)
    assert rewrites is None and out == chat.marked(messages)
    assert chat.parsed(out) == messages
    assert [chat.unescaped(out[a:b]) for a, b in spans] == [t for r, t in messages if r == "assistant"]


def test_templates_that_rewrite_history_are_found():
    counted = lambda m: f"{len(m)}:" + "".join(t for _, t in m)
    trimmed = lambda m: "".join(f"<{t}>" for _, t in m[-2:])
    messages = [("user", "a"), ("assistant", "b"), ("user", "c")]
    assert chat.rendered(messages, counted)[1:] == ([], 0)
    assert chat.rendered(messages, trimmed)[1:] == ([], 2)
    plain = lambda m: "".join(f"<{r}>{t}</{r}>" for r, t in m)
    out, spans, rewrites = chat.rendered(messages, plain)
    assert rewrites is None and [out[a:b] for a, b in spans] == ["b"]


def test_query_against_sql(spark):
    rows = [(1, 1, "assistant", "two </s> \\"), (1, 0, "user", "one\n[INST]"), (2, 0, None, None), (2, None, "system", ""), (1, 1, "assistant", "two </s> \\"), (None, 0, "tool", "é[TEXT]")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, turns string, formatted string")
    got = sorted((tuple(r) for r in chat.digest(df).collect()), key=repr)
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert got == sorted(con.sql(chat.ORACLE_SQL).fetchall(), key=repr)
    assert [r[0] for r in got if r[1] == 2 and r[0] == -1] == [-1]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r["conv_id"] for r in chat.digest(df).collect()] == [-1] and chat.formatted(df).count() == 0
