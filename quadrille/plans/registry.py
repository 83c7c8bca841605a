"""The graph engine's part of the driver contract."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.terms import RDF_TYPE, XSD
from quadrille.operators.paths import hop_stats
from quadrille.operators.updates import changed, update
from quadrille.plans.catalogue import METHOD, PREFIXES, QUERIES
from quadrille.plans.compiler import run
from quadrille.plans.expressions import register_function
from quadrille.sources.files import ntriples_lines, parse_ntriples
from quadrille.sources.graph import EX, TripleGraph, driver_graph
from quadrille.sources.results import json_bindings, tsv_rows

register_function(EX + "fn/halved", lambda x: (x / 2, "num"))

#: Tables that are also kept as stored triples: class, key, predicates with their columns and
#: how these are written (a kind, or the table that they refer to).
STORED = {
    "region": ("Region", "r_regionkey", {"name": ("r_name", "str")}),
    "nation": ("Nation", "n_nationkey", {"name": ("n_name", "str"), "region": ("n_regionkey", "region")}),
    "customer": ("Customer", "c_custkey", {"name": ("c_name", "str"), "acctbal": ("c_acctbal", "double"), "segment": ("c_mktsegment", "str"), "nation": ("c_nationkey", "nation")}),
    "supplier": ("Supplier", "s_suppkey", {"name": ("s_name", "str"), "acctbal": ("s_acctbal", "double"), "nation": ("s_nationkey", "nation")}),
    "part": ("Part", "p_partkey", {"name": ("p_name", "str"), "brand": ("p_brand", "str"), "ptype": ("p_type", "str"), "size": ("p_size", "integer"), "retailPrice": ("p_retailprice", "double")}),
    "orders": ("Order", "o_orderkey", {"status": ("o_orderstatus", "str"), "totalPrice": ("o_totalprice", "double"), "orderDate": ("o_orderdate", "dateTime"), "priority": ("o_orderpriority", "str"), "customer": ("o_custkey", "customer")}),
}


def _stored_sql() -> str:
    """The stored triples in SQL."""

    def iri(table: str, key: str) -> str:
        return f"'<{EX}{table}/' || {key} || '>'"

    def term(column: str, kind: str) -> str:
        if kind in STORED:
            return iri(kind, column)
        if kind == "str":
            return f"'\"' || {column} || '\"'"
        text = f"strftime({column}, '%Y-%m-%dT%H:%M:%S')" if kind == "dateTime" else f"CAST({column} AS VARCHAR)"
        return f"'\"' || {text} || '\"^^<{XSD}{kind}>'"

    parts = []
    for table, (cls, key, columns) in STORED.items():
        parts.append(f"SELECT {iri(table, key)} AS s, '<{RDF_TYPE}>' AS p, '<{EX}{cls}>' AS o FROM {table}")
        parts += [f"SELECT {iri(table, key)}, '<{EX}{p}>', {term(*c)} FROM {table}" for p, c in columns.items()]
    return " UNION ALL ".join(parts)


_TRIPLES = _stored_sql()
_INSERTED = "SELECT '<http://ex/nation/3>' AS s, '<http://ex/note>' AS p, '\"new\"' AS o UNION ALL SELECT '<http://ex/x>', '<http://ex/y>', '\"5\"^^<http://www.w3.org/2001/XMLSchema#integer>'"
UPDATES = {
    "insert_data": ('INSERT DATA { <http://ex/nation/3> :name "NATION_3" ; :note "new" . :x :y 5 }', f"SELECT * FROM ({_TRIPLES}) UNION ALL {_INSERTED}"),
    "delete_data": ('DELETE DATA { <http://ex/nation/3> :name "NATION_3" ; :note "none" }', f"SELECT * FROM ({_TRIPLES}) WHERE NOT (s = '<http://ex/nation/3>' AND p = '<http://ex/name>')"),
    "delete_where": ("DELETE WHERE { ?n :region <http://ex/region/1> }", f"SELECT * FROM ({_TRIPLES}) WHERE NOT (p = '<http://ex/region>' AND o = '<http://ex/region/1>')"),
    "modify": (
        "DELETE { ?n :region ?r } INSERT { ?r :hasNation ?n } WHERE { ?n :region ?r FILTER(?r != <http://ex/region/2>) }",
        f"SELECT * FROM ({_TRIPLES}) WHERE p <> '<http://ex/region>' OR o = '<http://ex/region/2>' UNION ALL SELECT '<http://ex/region/' || n_regionkey || '>', '<http://ex/hasNation>', '<http://ex/nation/' || n_nationkey || '>' FROM nation WHERE n_regionkey <> 2",
    ),
}
#: Queries over the stored triples.
ON_STORED = {
    "stored_star": ("SELECT ?o ?t ?d WHERE { ?o a :Order ; :totalPrice ?t ; :orderDate ?d ; :status \"P\" }", "SELECT 'http://ex/orders/' || o_orderkey AS o, CAST(o_totalprice AS VARCHAR) AS t, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS d FROM orders WHERE o_orderstatus = 'P'"),
    "stored_chain": ("SELECT ?o ?x WHERE { ?o :customer ?c . ?c :nation ?n . ?n :region ?r . ?r :name ?x }", "SELECT 'http://ex/orders/' || o_orderkey AS o, r_name AS x FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "stored_const": ("SELECT ?p ?o WHERE { <http://ex/customer/5> ?p ?o }", f"SELECT trim(p, '<>') AS p, CASE WHEN o[1] = '<' THEN trim(o, '<>') ELSE string_split(trim(o, '\"'), '\"^^')[1] END AS o FROM ({_TRIPLES}) WHERE s = '<http://ex/customer/5>'"),
    "stored_same_variable": ("SELECT (COUNT(*) AS ?n) WHERE { ?x ?p ?x }", "SELECT CAST(0 AS BIGINT) AS n"),
    "stored_min_max": ("SELECT ?b (MIN(?z) AS ?lo) (MAX(?z) AS ?hi) (SUM(?z) AS ?total) WHERE { ?p :size ?z ; :brand ?b } GROUP BY ?b", "SELECT p_brand AS b, CAST(min(p_size) AS VARCHAR) AS lo, CAST(max(p_size) AS VARCHAR) AS hi, CAST(sum(p_size) AS VARCHAR) AS total FROM part GROUP BY 1"),
    "stored_min_text": ("SELECT ?s (MIN(?n) AS ?lo) (MAX(?n) AS ?hi) WHERE { ?c :segment ?s ; :name ?n } GROUP BY ?s", "SELECT c_mktsegment AS s, min(c_name) AS lo, max(c_name) AS hi FROM customer GROUP BY 1"),
    "stored_filter": ("SELECT ?c WHERE { ?c a :Customer ; :acctbal ?b ; :name ?n FILTER(?b > 5000 && contains(?n, \"1\")) }", "SELECT 'http://ex/customer/' || c_custkey AS c FROM customer WHERE c_acctbal > 5000 AND contains(c_name, '1')"),
    "stored_optional": ("SELECT ?c ?o WHERE { ?c a :Customer OPTIONAL { ?o :customer ?c ; :status \"P\" } }", "SELECT 'http://ex/customer/' || c_custkey AS c, 'http://ex/orders/' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'"),
    "stored_path": ("SELECT ?c (shortestPathLen(?c, <http://ex/region/1>, true, {}) AS ?v) WHERE { ?c a :Customer }", "SELECT 'http://ex/customer/' || c_custkey AS c, CASE WHEN n_regionkey = 1 THEN CAST(2 AS BIGINT) END AS v FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "stored_topk": ("SELECT ?o ?b ?t WHERE { ?o :customer ?c ; :totalPrice ?t . ?c :acctbal ?b } ORDER BY DESC(?t + ?b) ?o LIMIT 9", "SELECT 'http://ex/orders/' || o_orderkey AS o, CAST(c_acctbal AS VARCHAR) AS b, CAST(o_totalprice AS VARCHAR) AS t FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice + c_acctbal DESC, o LIMIT 9"),
}


def stored(spark: SparkSession, sf_dir: str) -> TripleGraph:
    """The tables of STORED, whole, as stored triples."""
    g = driver_graph(spark, sf_dir).of_classes(*[EX + cls for cls, _, _ in STORED.values()])
    return TripleGraph(g.triples(), g.links())


def _sparql(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(driver_graph(spark, sf_dir), QUERIES[name][0], PREFIXES, method=METHOD.get(name))


def _stored(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(stored(spark, sf_dir), ON_STORED[name][0], PREFIXES, method="DP-B" if name == "stored_topk" else None)


def _update(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return update(stored(spark, sf_dir), UPDATES[name][0], PREFIXES).triples()


def update_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many triples an update takes away and adds."""
    return changed(stored(spark, sf_dir), UPDATES["insert_data"][0].replace("INSERT DATA", "DELETE { ?s :size ?z } INSERT") + " WHERE { ?s :size ?z }", PREFIXES)


def ntriples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored triples written as N-Triples lines and read again."""
    return parse_ntriples(ntriples_lines(stored(spark, sf_dir).triples())).triples()


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(stored(spark, sf_dir), "SELECT ?c ?b ?o WHERE { ?c a :Customer ; :acctbal ?b OPTIONAL { ?o :customer ?c ; :status \"P\" } }", PREFIXES, terms=True)


def tsv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tsv_rows(_terms(spark, sf_dir))


def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_bindings(_terms(spark, sf_dir))


def predicate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).predicate_stats()


def all_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).nodes(literals=False)


def all_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).predicates()


def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = driver_graph(spark, sf_dir)
    return run(g, "SELECT ?type (COUNT(*) AS ?n) WHERE { ?s a ?type } GROUP BY ?type", PREFIXES)


def hop_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the account balances that nations and regions reach in one and two hops
    against the edges :nation and :region."""
    g = driver_graph(spark, sf_dir)
    numbers = run(g, "SELECT ?s ?value WHERE { ?s a :Customer ; :acctbal ?value }", PREFIXES).select(F.concat(F.lit("<"), "s", F.lit(">")).alias("s"), F.lit("acctbal").alias("p"), "value")
    edges = g.edges([EX + "nation", EX + "region"]).select(F.col("o").alias("s"), "p", F.col("s").alias("o"))
    return hop_stats(edges, numbers, 2).where("hop > 0").select("v", "p", "hop", "lo", "hi")


SCANS = {f.__name__: f for f in (predicate_stats, all_entities, all_predicates, type_counts, ntriples, tsv_sink, json_sink, update_counts)}


def queries():
    found = {name: partial(_sparql, name) for name in QUERIES}
    found |= {name: partial(_update, name) for name in UPDATES} | {name: partial(_stored, name) for name in ON_STORED}
    return found | SCANS | {"hop_stats": hop_statistics}


def oracle_sql():
    found = {name: sql for name, (_, sql) in (QUERIES | UPDATES | ON_STORED).items()}
    tables = {"Region": "region", "Nation": "nation", "Customer": "customer", "Supplier": "supplier", "Part": "part", "Order": "orders", "Lineitem": "lineitem", "Event": "events", "Document": "documents", "Label": "labels", "Turn": "conversations", "Page": "pages", "Item": "benchmark", "Vector": "embeddings"}
    solutions = "customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'"
    return found | {
        "predicate_stats": f"SELECT p, count(*) AS n, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM ({_TRIPLES}) GROUP BY p",
        "all_entities": f"SELECT s AS n FROM ({_TRIPLES}) UNION SELECT o FROM ({_TRIPLES}) WHERE o[1] = '<'",
        "all_predicates": f"SELECT DISTINCT p FROM ({_TRIPLES})",
        "ntriples": _TRIPLES,
        "tsv_sink": f"SELECT '<http://ex/customer/' || c_custkey || '>' || chr(9) || '\"' || CAST(c_acctbal AS VARCHAR) || '\"^^<{XSD}double>' || chr(9) || coalesce('<http://ex/orders/' || o_orderkey || '>', '') AS value FROM {solutions}",
        "json_sink": f"SELECT '{{\"c\":{{\"type\":\"uri\",\"value\":\"http://ex/customer/' || c_custkey || '\"}},\"b\":{{\"type\":\"literal\",\"value\":\"' || CAST(c_acctbal AS VARCHAR) || '\",\"datatype\":\"{XSD}double\"}}' || coalesce(',\"o\":{{\"type\":\"uri\",\"value\":\"http://ex/orders/' || o_orderkey || '\"}}', '') || '}}' AS value FROM {solutions}",
        "update_counts": "SELECT count(*) AS deleted, CAST(2 AS BIGINT) AS inserted FROM part",
        "type_counts": " UNION ALL ".join(f"SELECT 'http://ex/{c}' AS type, count(*) AS n FROM {t}" for c, t in tables.items()),
        "hop_stats": "SELECT '<http://ex/nation/' || c_nationkey || '>' AS v, 'acctbal' AS p, 1 AS hop, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY c_nationkey UNION ALL SELECT '<http://ex/region/' || n_regionkey || '>', 'acctbal', 2, min(c_acctbal), max(c_acctbal) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey",
    }
