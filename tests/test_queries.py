"""Every registered engine query against its SQL in DuckDB, on the smallest data."""

import os

import duckdb
import pytest

from tarn import queries
from tarn.sources.graphs import MappedGraph

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels benchmark pages conversations embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float) and v == int(v):
        return int(v)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([plain(r[k]) for k in order]) for r in data)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    want = duck.sql(queries.oracle_sql()[name])
    kinds = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    assert sorted(df.dtypes) == sorted((c, kinds.get(str(t), str(t))) for c, t in zip(want.columns, want.types, strict=True))
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_flagship_plan_is_six_scans_and_five_joins(spark):
    df = queries.queries()["flagship"](spark, DATA)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 6 and plan.count("Join Inner") == 5 and "concat" not in plan


def test_filters_reach_the_scan(spark):
    plan = queries.queries()["filter_date"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "o_totalprice" not in plan
    plan = queries.queries()["bgp_constant_iri"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,7)" in plan


def plan_of(spark, name):
    return queries.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["optional_twice", "optional_of_union", "minus_after_optional", "exists_after_optional", "not_exists_after_optional"])
def test_unbound_variables_need_no_nested_loop(spark, name):
    plan = plan_of(spark, name)
    loops = plan.count("BroadcastNestedLoopJoin") + plan.count("CartesianProduct")
    # rows of that union that bind neither shared variable are compatible with all: one loop for matches, one for the rest
    assert loops == (2 if name == "optional_of_union" else 0)


@pytest.mark.parametrize(("name", "tables"), [("path_star_from_values", {"nation", "supplier", "customer"}), ("path_star_free", {"nation", "region"})])
def test_seeded_closures_read_only_tables_that_may_hold_their_seeds(spark, monkeypatch, name, tables):
    seen = set()
    monkeypatch.setattr(MappedGraph, "table", lambda g, t, table=MappedGraph.table: (seen.add(t), table(g, t))[1])
    queries.queries()[name](spark, DATA)
    assert seen == tables
