"""Conversation repair: shortest paths against all edit sequences, the query against SQL."""

from __future__ import annotations

import re
from hashlib import sha256
from itertools import product
from zlib import crc32

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import repair

#: A conversation whose only row is dropped.
DROPPED = next(c for c in range(1000, 2000) if crc32(f"{c}:0".encode()) % 20 == 0)
SCHEMA = "conv_id long, turn long, role string, text string, n string, _key string, first string, audit string"


def all_repairs(rows):
    """The least (cost, labels, repaired text) over every sequence of edits with up to two insertions in each gap."""
    costs, best = repair.Costs(), None
    inserts = ["", "u", "a", "ua", "au"]
    choices = []
    for role, text, fault in rows:
        late = costs.truncated if fault == "truncated" else 0
        kept = [] if fault in ("blank", "duplicate") else [("K", late, role[:1] or "?", f"{role}:{text}"), ("R", 1 + late, "u", f"user:{text}"), ("R", 1 + late, "a", f"assistant:{text}")]
        choices.append([("D", 2, "", None), *kept])
    for edits in product(*choices):
        for gaps in product(inserts, repeat=len(rows) + 1):
            initials = gaps[0] + "".join(e[2] + g for e, g in zip(edits, gaps[1:], strict=True))
            if not re.fullmatch("(s?(ua)+)?", initials):
                continue
            cost = sum(e[1] for e in edits) + 5 * sum(map(len, gaps))
            labels = "I" * len(gaps[0]) + "".join(e[0] + "I" * len(g) for e, g in zip(edits, gaps[1:], strict=True))
            said = [repair.ROLES[x] + ":" for x in gaps[0]]
            for e, g in zip(edits, gaps[1:], strict=True):
                said += [e[3]] * (e[3] is not None) + [repair.ROLES[x] + ":" for x in g]
            found = (cost, labels, sha256("\n".join(said).encode()).hexdigest())
            best = found if best is None else min(best, found)
    return best


ROW = st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "ux", ""]), st.sampled_from(["a.", "é"]), st.sampled_from(["", "", "truncated", "blank", "duplicate"]))


@settings(max_examples=60, deadline=None)
@given(st.lists(ROW, max_size=3))
def test_shortest_path_against_all_edit_sequences(rows):
    machine = repair.Repair(repair.Costs())
    for row in rows:
        machine.row(*row)
    assert machine.ended() == all_repairs(rows)


def plain(rows):
    """A plain loop with whole label strings, for longer conversations."""
    costs, paths = repair.Costs(), {0: (0, "")}

    def relaxed(paths):
        for _ in range(3):
            for state, (cost, labels) in list(paths.items()):
                for x, to in repair.GRAMMAR[state].items():
                    if x in "ua":
                        paths[to] = min(paths.get(to, (10**9, "")), (cost + costs.insert, labels + "I"))
        return paths

    for role, _, fault in rows:
        found = {}
        for state, (cost, labels) in relaxed(dict(paths)).items():
            ways = [(state, cost + 2, "D")]
            if fault not in ("blank", "duplicate"):
                late = 5 if fault else 0
                ways += [(repair.GRAMMAR[state].get(role[:1]), cost + late, "K")] + [(repair.GRAMMAR[state].get(x), cost + late + 1, "R") for x in "ua"]
            for to, c, label in ways:
                if to is not None:
                    found[to] = min(found.get(to, (10**9, "")), (c, labels + label))
        paths = found
    return min(w for s, w in relaxed(paths).items() if s in repair.FINAL)


@settings(max_examples=100, deadline=None)
@given(st.lists(ROW, max_size=40))
def test_long_conversations_against_whole_strings(rows):
    machine = repair.Repair(repair.Costs())
    for row in rows:
        machine.row(*row)
    assert machine.ended()[:2] == plain(rows)


def sql_rows(rows):
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    return sorted((tuple(r) for r in con.sql(repair.ORACLE_SQL).fetchall()), key=repr)


@pytest.fixture(scope="module")
def odd_rows():
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    texts = ["Yes.", "No", None, "", " \t", "Is it? ", "x.\n", "été!", "a.b"]
    rows = [(c, t, roles[(c * 7 + t * 3) % 7] if c % 2 else roles[t % 2], texts[(c * 5 + t * t) % 9] if c % 3 else f"t{t}.") for c in range(60) for t in range(c % 9)]
    return [*rows, (None, 0, "user", "x."), (None, None, None, None), (7, None, "user", "Yes."), (7, None, "user", "No"), (8, 1, "user", "y."), (8, 1, "user", "y."), (90, 5, "user", "z."), (90, 12, "assistant", "z."), (DROPPED, 0, "user", "z.")]


def test_query_against_sql_on_odd_rows(spark, odd_rows):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in odd_rows], SCHEMA)
    got = sorted((tuple(r) for r in repair.digest(df).collect()), key=repr)
    assert got == sql_rows(odd_rows)
    assert len(got) == len({r[0] for r in odd_rows}) and any(r[7] == "" for r in got)


def test_one_long_conversation_and_empty_table(spark):
    rows = [(1, t, ("user", "assistant", "assistant")[t % 3], f"said {t % 700}" + "." * (t % 4 > 0)) for t in range(3000)] + [(2, 0, "user", "a.")]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in repair.digest(df).collect()), key=repr) == sql_rows(rows)
    assert repair.digest(df.limit(0)).collect() == []


def test_repaired_turns_say_what_the_digest_hashes(spark, odd_rows):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in odd_rows], SCHEMA)
    turns = repair.repaired_turns(df).collect()
    plain_rows = df.selectExpr("conv_id", "turn", "coalesce(role, ' ') role", "coalesce(text, ' ') text", "1L n")
    for r in repair.repairs(plain_rows).collect():
        said = sorted((t["place"], f"{t['role']}:{t['text']}", t["edit"]) for t in turns if t["conv_id"] == r["conv_id"])
        assert sha256("\n".join(s for _, s, _ in said).encode()).hexdigest() == r["repaired_sha256"]
        assert "".join(e for *_, e in said) == r["audit"].replace("D", "")
