"""Every registered query of the graph engine against its SQL, and top-k methods."""

import glob
import math
import os

import duckdb
import pytest

from quadrille.operators.paths import path_call
from quadrille.plans import registry
from quadrille.plans.catalogue import METHOD, PREFIXES, QUERIES
from quadrille.plans.compiler import run
from quadrille.sources.graph import driver_graph

SF = "/root/testdata/sf0.001"
FOUND, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        return None if x is None or (isinstance(x, float) and math.isnan(x)) else float(f"{x:.10g}") if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", sorted(FOUND))
def test_against_sql(spark, con, name):
    df = FOUND[name](spark, SF)
    sql = con.execute(SQL[name])
    columns = [c[0] for c in sql.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(columns, sql.fetchall())


@pytest.mark.parametrize("name", sorted(METHOD))
def test_pruned_equals_sorted(spark, name):
    if name == "topk_nonnumeric":
        pytest.skip("a plain sort keeps values that are no numbers")
    g = driver_graph(spark, SF)
    rows = [[tuple(r) for r in run(g, QUERIES[name][0], PREFIXES, method=m).collect()] for m in ("Naive", "DP-B")]
    assert rows[0] == rows[1]


def test_fanout_is_pruned_before_the_join(spark):
    g = driver_graph(spark, SF)
    df = run(g, QUERIES["topk_fanout"][0], PREFIXES, method="PTAB")
    assert "WindowGroupLimit" in df._jdf.queryExecution().toString()


def test_filter_and_columns_reach_the_scan(spark):
    g = driver_graph(spark, SF)
    plan = run(g, QUERIES["bgp_const_object"][0], PREFIXES)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan and "o_totalprice" not in plan.split("ReadSchema")[1]


def test_cycles_and_walks_without_a_bound(spark):
    ring = [(f"n{i}", "p", f"n{(i + 1) % 9}") for i in range(9)]
    edges = spark.createDataFrame([*ring, ("n3", "q", "n2"), ("x", "p", "n0")], "s string, p string, o string")
    pairs = spark.createDataFrame([("n0", "n5"), ("n2", "n3"), ("x", "n0")], "src string, dst string")
    whole = " p ".join(f"n{i % 9}" for i in range(10))
    got = {(r.src, r.dst): r.value for r in path_call("simplecyclepath", pairs, edges, True, None)[0].collect()}
    assert got == {("n0", "n5"): whole, ("n2", "n3"): "n2 p n3 q n2"}
    assert {r.src for r in path_call("simplecycleboolean", pairs, edges, True, 8)[0].collect()} == {"n2"}
    far = spark.createDataFrame([("n0", "n8")], "src string, dst string")
    assert [r.value for r in path_call("khopenumerate", far, edges, True, -1)[0].collect()] == [whole[: whole.rindex(" p ")]]


@pytest.mark.parametrize("name", ["optional_chain", "minus_unbound", "exists_unbound", "exists_twice", "exists_projected"])
def test_uncertain_keys_need_no_nested_loop(spark, name):
    plan = FOUND[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "monotonically" not in plan


def test_products_come_last_and_objects_tell_tables(spark):
    g = driver_graph(spark, SF)
    text = "SELECT ?c ?s WHERE { ?c a :Customer ; :nation <http://ex/nation/3> . ?s a :Supplier ; :nation ?n . ?n :region ?r . ?r :name \"ASIA\" }"
    plan = run(g, text, PREFIXES)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [x.strip(" :+-") for x in plan if "Join" in x]
    assert joins[0] in ("Join Inner", "Join Cross") and len(joins) == 3 and all("=" in x for x in joins[1:])
    assert not any("Union" in x for x in plan)  # a nation's region is a row of one table


def test_chains_are_pruned_bottom_up(spark):
    g = driver_graph(spark, SF)
    plan = run(g, QUERIES["topk_long_chain"][0], PREFIXES, method="DP-P")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("WindowGroupLimit") + plan.count("Window [row_number") >= 2
