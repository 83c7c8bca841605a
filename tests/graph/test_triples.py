"""Stored triples: files, semantics of group patterns, paths, updates, sinks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quadrille.operators.paths import path_call
from quadrille.operators.updates import changed, update
from quadrille.plans.compiler import run
from quadrille.plans.expressions import register_function
from quadrille.plans.syntax import QueryError, parse_query
from quadrille.sources.catalog import Catalog
from quadrille.sources.files import from_text, parse_ntriples, parse_turtle, read_ntriples, read_turtle, write_ntriples
from quadrille.sources.graph import TripleGraph
from quadrille.sources.results import to_json, to_tsv
from quadrille.streaming.ingest import ingest, triple_stream

PEOPLE = """
@prefix : <http://x/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:a :name "Ann" ; :knows :b , :c ; :age 30 ; :height 1.75e0 ; a :Person .
:b :name "Bob"@en ; :knows :c ; :age "31"^^xsd:integer ; :born "1990-05-06T07:08:09"^^xsd:dateTime .
:c :name "Cat" ; :age "old" ; :likes ( :a :b ) ; :home [ :city "Ulm" ] .
:d :knows :d ; :flag true .
broken here .
:e :big "300"^^xsd:byte ; :n "NaN"^^xsd:double ; :ok "5"^^xsd:byte .
"""
P = {"": "http://x/"}


@pytest.fixture(scope="module")
def g(spark):
    g = from_text(spark, PEOPLE)
    return TripleGraph(g.df.cache())


def rows(g, text, **kw):
    return sorted((tuple(r) for r in run(g, text, P, **kw).collect()), key=str)


def ids(*names):
    return sorted([(f"http://x/{n}",) for n in names], key=str)


def test_turtle():
    got = parse_turtle(PEOPLE)
    assert ("<http://x/b>", "<http://x/name>", '"Bob"@en') in got
    assert ("<http://x/a>", "<http://x/height>", '"1.75e0"^^<http://www.w3.org/2001/XMLSchema#double>') in got
    assert sum(p.endswith("#first>") for _, p, _ in got) == 2
    assert not any("broken" in x for t in got for x in t)


def test_badly_typed_are_dropped(g):
    assert rows(g, "SELECT ?p WHERE { :e ?p ?o }") == ids("ok")


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("SELECT ?x WHERE { ?x :knows ?x }", ids("d")),
        ('SELECT ?x WHERE { ?x :name "Bob" }', []),
        ('SELECT ?x WHERE { ?x :name "Bob"@en }', ids("b")),
        ("SELECT ?x WHERE { ?x :age ?a FILTER(?a > 30) }", ids("b")),
        ("SELECT ?x WHERE { ?x :age ?a FILTER(?a = 30.0) }", ids("a")),
        ("SELECT ?x WHERE { ?x :age 30.0 }", []),
        ("SELECT ?x WHERE { ?x :age ?a FILTER(isNumeric(?a)) }", ids("a", "b")),
        ('SELECT ?x WHERE { ?x :name ?n FILTER(lang(?n) = "en") }', ids("b")),
        ('SELECT ?x WHERE { ?x :name ?n FILTER langMatches(lang(?n), "EN") }', ids("b")),
        ('SELECT ?x WHERE { ?x :name ?n FILTER regex(str(?n), "^b", "i") }', ids("b")),
        ("SELECT ?x WHERE { ?x :born ?t FILTER(year(?t) = 1990 && hours(?t) = 7) }", ids("b")),
        ("SELECT ?x WHERE { ?x :flag ?f FILTER(?f) }", ids("d")),
        ("SELECT ?x WHERE { ?x :name ?n OPTIONAL { ?x :knows ?k } FILTER(!bound(?k)) }", ids("c")),
        ("SELECT ?x WHERE { ?x :name ?n MINUS { ?y :knows ?x } }", ids("a")),
        ("SELECT ?x WHERE { ?x :name ?n MINUS { :a :b :c } }", ids("a", "b", "c")),
        ("SELECT ?x WHERE { ?x :name ?n FILTER NOT EXISTS { ?x :knows ?k } }", ids("c")),
        ("SELECT ?y WHERE { :a :knows+ ?y }", ids("b", "c")),
        ("SELECT ?y WHERE { ?y :knows* :c }", ids("a", "b", "c")),
        ("SELECT ?y WHERE { :c :likes/(<http://www.w3.org/1999/02/22-rdf-syntax-ns#rest>*/<http://www.w3.org/1999/02/22-rdf-syntax-ns#first>) ?y }", ids("a", "b")),
        ("SELECT ?y WHERE { :c :home/:city ?y }", [("Ulm",)]),
        ("SELECT ?y WHERE { :c :home ?h FILTER(isBlank(?h)) BIND(1 AS ?y) }", [(1,)]),
        ("SELECT ?x ?k WHERE { ?x :name ?n OPTIONAL { ?x :knows ?k FILTER(?k = :b) } }", [("http://x/a", "http://x/b"), ("http://x/b", None), ("http://x/c", None)]),
        ("SELECT (COUNT(*) AS ?n) (SUM(?a) AS ?s) WHERE { ?x :age ?a }", [(3, "61")]),
        ("ASK { :a :knows :c }", [(True,)]),
    ],
)
def test_semantics(g, query, want):
    assert rows(g, query) == sorted(want, key=str)


def test_unbound_variable_joins_as_a_wild_card(g):
    got = rows(g, "SELECT ?x ?k WHERE { { ?x :name \"Cat\" OPTIONAL { ?x :knows ?k } } { :a :knows ?k } }")
    assert got == [("http://x/c", "http://x/b"), ("http://x/c", "http://x/c")]


def test_order_of_terms(g):
    got = [r[0] for r in run(g, "SELECT ?o WHERE { ?s :knows|:age|:name ?o } ORDER BY ?o", P, terms=True).collect()]
    assert [x[0] for x in got] == ["<"] * 4 + ['"'] * 6
    numbers = [x for x in got if "integer" in x]
    assert numbers == ['"30"^^<http://www.w3.org/2001/XMLSchema#integer>', '"31"^^<http://www.w3.org/2001/XMLSchema#integer>']


def test_paths(spark):
    g = from_text(spark, "@prefix : <http://x/> . :a :p :b . :b :p :c . :c :p :d . :d :q :a . :a :q :c . :c :name \"lit\" .")
    one = lambda call: run(g, f"SELECT ({call} AS ?v) WHERE {{ :a :p :b }}", P).collect()[0][0]
    assert one("kHopReachable(:a, :d, true, 2, {:p})") is False
    assert one("kHopReachable(:a, :d, true, 3, {:p})") is True
    assert one("kHopReachable(:d, :a, false, 3, {:p})") is True
    assert one("shortestPathLen(:a, :d, true, {:p})") == 3
    assert one("shortestPathLen(:a, :d, true, {})") == 2
    assert one("shortestPathLen(:d, :a, true, {:p})") is None
    assert one("shortestPath(:a, :a, true, {:p})") == "<http://x/a>"
    assert one("shortestPath(:a, :d, true, {}, 0.5)") == "<http://x/a> <http://x/q> <http://x/c> <http://x/p> <http://x/d>"
    assert one("cycleBoolean(:a, :c, true, {:p, :q})") is True
    assert one("cycleBoolean(:a, :c, true, {:p})") is False
    assert one("cyclePath(:a, :c, true, {:p, :q})").count("<http://x/a>") == 2
    assert one("simpleCycleBoolean(:a, :b, true, 4, {:p, :q})") is True
    assert one("simpleCycleBoolean(:a, :b, true, 3, {:p, :q})") is False
    found = run(g, "SELECT (kHopEnumerate(:a, :c, true, 3, {}) AS ?v) WHERE { :a :p :b }", P).collect()
    assert len(found) == 2


def test_topk_drops_what_is_no_number(spark):
    g = from_text(spark, "@prefix : <http://x/> . :r :has :a , :b , :c , :d . :a :v 3 . :b :v \"12abc\" . :c :v 5 . :d :v :a .")
    text = "SELECT ?x ?n WHERE { :r :has ?x . ?x :v ?n } ORDER BY DESC(?n) LIMIT 3"
    assert [tuple(r) for r in run(g, text, P, method="PTAB").collect()] == [("http://x/c", "5"), ("http://x/a", "3")]
    with pytest.raises(QueryError):
        run(g, text, P, method="nope")


def test_updates(spark):
    g = from_text(spark, "@prefix : <http://x/> . :a :p :b . :b :p :c .")
    g = update(g, "INSERT DATA { :a :p :b ; :p :d }", P)
    assert g.triples().count() == 3
    g = update(g, "DELETE { ?x :p ?y } INSERT { ?y :q ?x } WHERE { ?x :p ?y FILTER(?y != :d) }", P)
    assert rows(g, "SELECT ?x ?y WHERE { ?x :q ?y }") == [("http://x/b", "http://x/a"), ("http://x/c", "http://x/b")]
    assert update(g, "DELETE WHERE { ?x :q ?y }", P).triples().count() == 1


def test_files_and_sinks(spark, tmp_path, g):
    write_ntriples(g.triples(), str(tmp_path / "nt"))
    back = read_ntriples(spark, str(tmp_path / "nt"))
    assert sorted(back.triples().collect()) == sorted(g.triples().collect())
    g.save(str(tmp_path / "table"))
    assert TripleGraph.load(spark, str(tmp_path / "table")).triples().count() == g.triples().count()
    (tmp_path / "one.ttl").write_text(PEOPLE)
    assert read_turtle(spark, str(tmp_path / "one.ttl")).triples().count() == g.triples().count()
    df = run(g, "SELECT ?n ?a WHERE { ?x :name ?n OPTIONAL { ?x :age ?a FILTER(isNumeric(?a)) } } ORDER BY ?n", P, terms=True)
    got = json.loads(to_json(df))["results"]["bindings"]
    assert {"type": "literal", "value": "Bob", "xml:lang": "en"} in [b["n"] for b in got] and sum("a" in b for b in got) == 2
    assert to_tsv(df).splitlines()[0] == "?n\t?a" and to_tsv(df.where("false")).endswith("[empty result]\n")
    ingest(triple_stream(spark, str(tmp_path / "nt")), str(tmp_path / "stream"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "stream")).count() == g.triples().count()


@pytest.mark.parametrize("text", ["SELECT ?x WHERE { GRAPH ?g { ?x ?p ?o } }", "SELECT ?x FROM <a:b> WHERE { ?x ?p ?o }", "SELECT ?x WHERE { ?x :p }", "SELECT ?x { ?x zz:p ?y }", "SELECT WHERE { }"])
def test_rejected(text):
    with pytest.raises(QueryError):
        parse_query(text, P)


def test_grouping_rules(g):
    for text in ("SELECT * WHERE { ?x :age ?a } GROUP BY ?x", "SELECT ?a (COUNT(*) AS ?n) WHERE { ?x :age ?a } GROUP BY ?x"):
        with pytest.raises(QueryError):
            run(g, text, P)


def test_unicode_escapes(spark):
    lines = [r'<http://x/\u00E9> <http://x/p> "caf\u00e9 \U0001F600 \\u0041 \u0022q\u0022" .', r'<http://x/a> <http://x/p> "plain\n" .']
    got = {tuple(r) for r in parse_ntriples(spark.createDataFrame([(x,) for x in lines], "value string")).triples().collect()}
    assert got == {("<http://x/é>", "<http://x/p>", '"café 😀 ' + r'\\u0041 \"q\"' + '"'), ("<http://x/a>", "<http://x/p>", r'"plain\n"')}


def test_tags_and_terms_of_aggregates(spark):
    g = from_text(spark, '@prefix : <http://x/> . :a :l "Chat"@fr , "plain" . :a :v 3 , 12 , 2.5 . :b :v 7 , 4 . :b :l "Hund"@de .')
    one = lambda q: [tuple(r) for r in run(g, q, P, terms=True).collect()]
    assert sorted(one("SELECT (UCASE(?l) AS ?v) WHERE { :a :l ?l }")) == [('"CHAT"@fr',), ('"PLAIN"',)]
    assert one('SELECT (SUBSTR(?l, 0, 3) AS ?v) WHERE { :b :l ?l }') == [('"Hu"@de',)]
    assert one('SELECT (CONCAT(?l, ?l) AS ?v) WHERE { :b :l ?l }') == [('"HundHund"@de',)]
    assert one('SELECT (STRAFTER(?l, "u") AS ?v) (STRBEFORE(?l, "z") AS ?w) (REPLACE(?l, "n", "m") AS ?r) WHERE { :b :l ?l }') == [('"nd"@de', '""', '"Humd"@de')]
    xsd = "http://www.w3.org/2001/XMLSchema#"
    assert one("SELECT (MIN(?x) AS ?a) (MAX(?x) AS ?b) (SUM(?x) AS ?c) WHERE { :b :v ?x }") == [(f'"4"^^<{xsd}integer>', f'"7"^^<{xsd}integer>', f'"11"^^<{xsd}integer>')]
    assert one("SELECT (MAX(?x) AS ?b) (SUM(?x) AS ?c) WHERE { :a :v ?x }") == [(f'"12"^^<{xsd}integer>', f'"17.5"^^<{xsd}double>')]


def test_moments_with_zones(spark):
    g = from_text(spark, '@prefix : <http://x/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . :a :t "2020-01-01T00:30:00+02:00"^^xsd:dateTime . :b :t "2019-12-31T22:30:00Z"^^xsd:dateTime . :c :t "2020-01-01T00:30:00"^^xsd:dateTime .')
    assert rows(g, 'SELECT ?x WHERE { ?x :t ?t FILTER(?t = "2019-12-31T17:30:00-05:00"^^<http://www.w3.org/2001/XMLSchema#dateTime>) }') == ids("a", "b")
    assert rows(g, "SELECT ?x (HOURS(?t) AS ?h) (TZ(?t) AS ?z) WHERE { ?x :t ?t }") == [("http://x/a", 0, "+02:00"), ("http://x/b", 22, "Z"), ("http://x/c", 0, "")]
    assert rows(g, "SELECT ?x WHERE { ?x :t ?t BIND(TIMEZONE(?t) AS ?z) FILTER(bound(?z)) }") == ids("a", "b")


def test_counts_of_changes(spark):
    g = from_text(spark, "@prefix : <http://x/> . :a :p :b . :b :p :c .")
    assert [tuple(r) for r in changed(g, "INSERT DATA { :a :p :b ; :p :d ; :q :d }", P).collect()] == [(0, 2)]
    assert [tuple(r) for r in changed(g, "DELETE { ?x :p ?y } INSERT { ?x :p ?y . ?x :r ?y } WHERE { ?x :p ?y }", P).collect()] == [(2, 4)]
    assert [tuple(r) for r in changed(g, "DELETE DATA { :z :p :b }", P).collect()] == [(0, 0)]


def test_custom_functions_and_digests(g):
    import hashlib

    register_function("http://x/shout", lambda x: (F.concat(x, F.lit("!")), "str"))
    assert rows(g, 'SELECT (<http://x/shout>("a") AS ?v) WHERE { :a :age 30 }') == [("a!",)]
    got = rows(g, 'SELECT (SHA384("abc") AS ?a) (SHA512("abc") AS ?b) WHERE { :a :age 30 }')
    assert got == [(hashlib.sha384(b"abc").hexdigest(), hashlib.sha512(b"abc").hexdigest())]


def test_scans_of_entities(g):
    found = {r[0] for r in g.nodes(literals=False).collect()}
    assert "<http://x/a>" in found and not any(x.startswith('"') for x in found) and len(found) < g.nodes().count()
    assert "<http://x/knows>" in {r[0] for r in g.predicates().collect()}
    g.cache().unload()


def test_searches_from_the_side_of_fewer_nodes(spark):
    rng = random.Random(2)
    names = [f"n{i}" for i in range(14)]
    links = sorted({(rng.choice(names), rng.choice("pq"), rng.choice(names)) for _ in range(30)})
    edges = spark.createDataFrame(links, "s string, p string, o string")
    best = {n: {n: [n]} for n in names}
    for n in names:  # least of the shortest paths, by breadth
        front = {n: [n]}
        while front:
            step = {}
            for at, path in front.items():
                for s, p, o in links:
                    if s == at and o not in best[n]:
                        step[o] = min(step.get(o, [*path, p, o]), [*path, p, o])
            best[n] |= step
            front = step
    for pairs in ([("n0", x) for x in names], [(x, "n3") for x in names], [(x, y) for x in names[:4] for y in names[4:]]):
        df = spark.createDataFrame(pairs, "src string, dst string")
        want = {(a, b): " ".join(best[a][b]) for a, b in pairs if b in best[a]}
        assert {(r.src, r.dst): r.value for r in path_call("shortestpath", df, edges, True, None)[0].collect()} == want
        assert {(r.src, r.dst): r.value for r in path_call("shortestpathlen", df, edges, True, None)[0].collect()} == {k: v.count(" ") // 2 for k, v in want.items()}
        assert {(r.src, r.dst) for r in path_call("khopreachable", df, edges, True, 2)[0].collect()} == {k for k, v in want.items() if v.count(" ") <= 4}


def test_catalog(spark, tmp_path, g):
    catalog = Catalog(spark, str(tmp_path))
    assert catalog.names() == []
    catalog.build("people", g)
    catalog.build("few", from_text(spark, "@prefix : <http://x/> . :a :p :b ."))
    assert catalog.names() == ["few", "people"]
    assert rows(catalog.load("few"), "SELECT ?o WHERE { :a :p ?o }") == ids("b")
    assert [tuple(r) for r in run(catalog.system(), 'SELECT ?d ?n WHERE { ?d <database_status> "already_built" ; <triples> ?n } ORDER BY ?d', P).collect()] == [("few", "1"), ("people", str(g.triples().count()))]
    for bad in (lambda: catalog.build("few", g), lambda: catalog.load("none"), lambda: catalog.build("../x", g)):
        with pytest.raises(QueryError):
            bad()
    catalog.drop("few")
    assert catalog.names() == ["people"]
    assert catalog.build("few", g).triples().count() == g.triples().count()
