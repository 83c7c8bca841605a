"""Plans and results of queries whose cost has to follow the tables."""

import pytest

from quadrille.plans import registry
from quadrille.plans.catalogue import PREFIXES
from quadrille.plans.compiler import run
from quadrille.sources.files import from_text
from quadrille.sources.graph import driver_graph

SF = "/root/testdata/sf0.001"
FOUND = registry.queries()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_description_of_a_constant_joins_nothing(spark):
    plan = FOUND["describe"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "o_custkey" not in plan and "l_orderkey" not in plan
    assert plan.count("Exchange") == 1  # of what was found


def test_descriptions_of_constants_and_variables(spark):
    g = driver_graph(spark, SF).of_classes(*[f"http://ex/{c}" for c in ("Region", "Nation", "Supplier")])
    whole = g.triples().collect()
    assert rows(run(g, "DESCRIBE :Nation <http://ex/nation/3> <http://ex/nothing/3>", PREFIXES)) == sorted(tuple(r) for r in whole if {r.s, r.o} & {"<http://ex/nation/3>", "<http://ex/Nation>"})
    some = {"<http://ex/nation/3>", *(r.s for r in whole if r.s.startswith("<http://ex/region/"))}
    assert rows(run(g, "DESCRIBE ?r <http://ex/nation/3> WHERE { ?r a :Region }", PREFIXES)) == sorted(tuple(r) for r in whole if {r.s, r.o} & some)


def test_description_in_stored_triples(spark):
    g = from_text(spark, '@prefix : <http://ex/> . :a :p :a , :b ; :q "a" . :b :p :c . _:x :p :b .')
    want = [r for r in rows(g.triples()) if "<http://ex/b>" in r]
    assert len(want) == 3 and rows(run(g, "DESCRIBE :b", PREFIXES)) == want
    assert len(run(g, "DESCRIBE :a", PREFIXES).collect()) == 3


@pytest.mark.parametrize("text, term", [("<http://ex/nation/3>", "<http://ex/nation/3>"), (":Nation", "<http://ex/Nation>"), ('"REGION_1"', '"REGION_1"'), ("3", "none")])
def test_variable_predicate_of_a_constant_object(spark, text, term):
    g = driver_graph(spark, SF).of_classes(*[f"http://ex/{c}" for c in ("Region", "Nation", "Customer")])
    got = [(f"<{r.s}>", f"<{r.p}>") for r in run(g, f"SELECT ?s ?p WHERE {{ ?s ?p {text} }}", PREFIXES).collect()]
    assert sorted(got) == rows(g.triples().where(f"o = '{term}'").select("s", "p"))


def test_product_holds_the_few_rows(spark):
    plan = FOUND["optional_chain"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    outer, held = plan.split("CartesianProduct")[1].split("FileScan parquet ")[1:3]
    assert outer.startswith("[s_suppkey") and held.startswith("[o_orderkey")


def test_small_tables_that_meet_many_are_dealt_to_tasks(spark, monkeypatch):
    want = rows(FOUND["bgp_shared_object"](spark, SF))
    optional = "SELECT ?a ?b WHERE { ?a a :Customer ; :nation ?n OPTIONAL { ?b a :Supplier ; :nation ?n } }"
    whole = rows(run(driver_graph(spark, SF), optional, PREFIXES).na.fill("none"))
    monkeypatch.setattr("quadrille.plans.relation._DEALT", 100)
    for df, rows_ in ((FOUND["bgp_shared_object"](spark, SF), want), (run(driver_graph(spark, SF), optional, PREFIXES), whole)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "RoundRobinPartitioning" in plan and "BroadcastHashJoin" in plan
        assert rows(df.na.fill("none")) == rows_
    chain = run(driver_graph(spark, SF), "SELECT ?o ?l WHERE { ?o :customer ?c . ?c :nation ?n . ?l :order ?o }", PREFIXES)
    assert "RoundRobin" not in chain._jdf.queryExecution().executedPlan().toString()  # an order's lines are one order's


def test_plain_lines_are_read_as_all_lines_are(spark):
    from pyspark.sql import functions as F

    from quadrille.sources import files

    subjects = ["<a>", "<>", "<a b>", "_:x", "<a> <b>", "<a\\u0041>", "<a>x"]
    objects = ["<c>", "<>", "<c d>", "<c>>", "_:y", '""', '"a"', '"a b . "', '"é"@en', '"5"^^<t>', '"5"^^<>', '"5"^^<t>>', '"5"^^t', '"5"^<t>', '"a" "b"', '"a', '"', 'a"', '"a\\"b"', '"\\u00e9"', '"> <"', '"a> b"^^<x y>', "", "5", '"nan"^^<http://www.w3.org/2001/XMLSchema#double>', '"300"^^<http://www.w3.org/2001/XMLSchema#byte>', '"-7"^^<http://www.w3.org/2001/XMLSchema#byte>', '"x"^^<http://www.w3.org/2001/XMLSchema#string>']
    ends = [" .", ".", " . ", " . # c", "  .", " ..", " . <x> .", ""]
    lines = spark.createDataFrame([(f"{s} <p> {o}{e}",) for s in subjects for o in objects for e in ends] + [("<a>\t<p> <c> .",), ("<a> <p>  <c> .",), ("<a> p <c> .",), ("<a> <p>",), (" <a> <p> <c> .",), ("",), (None,)], "value string").repartition(1).cache()
    found = files._plain_lines(lines).where("plain")
    groups = [F.regexp_extract("value", files._NT, i) for i in (1, 2, 3)]
    assert found.count() > 20  # of whatever form, what is found is what the expression finds
    assert found.where((groups[0] != F.col("s")) | (groups[1] != F.col("p")) | (groups[2] != F.col("o"))).count() == 0
    got = rows(files.ntriples_terms(lines).distinct())
    assert ("<a>", "<p>", '"x"') in got and ("<aA>", "<p>", '"é"') in got and not any("nan" in o or "300" in o for _, _, o in got)
    slow = files._once(lines, [g.alias(n) for g, n in zip(groups, "spo", strict=True)]).where("s <> ''")
    assert rows(files._canonical(files._once(slow, [files._plain_characters(F.col(n)).alias(n) for n in "spo"])).distinct()) == got


def test_searches_read_links_and_broadcast_small_frontiers(spark):
    g = registry.stored(spark, SF)
    assert rows(g.links()) == rows(g.triples().where("o NOT LIKE '\"%'"))
    plan = g.edges([])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "o_totalprice" not in plan


def test_searches_with_and_without_broadcasts(spark, monkeypatch):
    from quadrille.operators.paths import path_call

    edges = spark.createDataFrame([("a", "p", "b"), ("a", "p", "b"), ("b", "p", "c"), ("c", "q", "a"), ("b", "q", "d"), ("x", "p", "a")], "s string, p string, o string")
    pairs = spark.createDataFrame([("a", "c"), ("b", "a"), ("x", "d"), ("d", "x"), ("a", "a")], "src string, dst string")

    def found():
        return [rows(path_call(name, pairs, edges, directed, k)[0]) for name, directed, k in (("shortestpathlen", True, None), ("khopenumerate", True, 2))]

    want = found()
    assert want[0] == [("a", "a", 0), ("a", "c", 2), ("b", "a", 2), ("x", "d", 3)] and len(want[1]) == 2
    monkeypatch.setattr("quadrille.operators.paths._FEW", -1)
    assert found() == want
