"""Registered queries against their SQL on the smallest tables; the driver contract."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from larkspur.plans import catalogue, catalogue_frames, catalogue_rules, catalogue_scale  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return str(value) if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    relation = con.sql(catalogue.SQL[name])
    assert sorted(df.columns) == sorted(relation.columns)
    order = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    places = [relation.columns.index(c) for c in order]
    assert got == sorted((tuple(plain(r[i]) for i in places) for r in relation.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_without_sql(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.QUERIES["scan_filter_project"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualNullSafe(l_returnflag,R)" in plan and "l_comment" not in plan and "l_shipdate" not in plan.split("ReadSchema")[-1]
