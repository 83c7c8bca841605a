"""The registered queries of the graph engine over the mapped test tables, each with the
SQL that answers the same question."""

from __future__ import annotations

from quadrille.functions.terms import RDF_TYPE, XSD

PREFIXES = {"": "http://ex/", "xsd": XSD}
_O, _C, _N, _R, _S, _P, _E = (f"'http://ex/{t}/' || " for t in ("orders", "customer", "nation", "region", "supplier", "part", "events"))
_INT, _DOUBLE = XSD + "integer", XSD + "double"


def _q(sparql: str, sql: str) -> tuple[str, str]:
    return sparql, sql


_NATION_TERMS = f"""
SELECT '<http://ex/nation/' || n_nationkey || '>' AS s, '<{RDF_TYPE}>' AS p, '<http://ex/Nation>' AS o FROM nation
UNION ALL SELECT '<http://ex/nation/' || n_nationkey || '>', '<http://ex/name>', '"' || n_name || '"' FROM nation
UNION ALL SELECT '<http://ex/nation/' || n_nationkey || '>', '<http://ex/region>', '<http://ex/region/' || n_regionkey || '>' FROM nation
"""
_PARTS = "{ ?p a :Part ; :name ?n ; :size ?z ; :retailPrice ?r }"


def _function(expr: str, sql: str) -> tuple[str, str]:
    """A projected expression over parts."""
    return _q(f"SELECT ?p ({expr} AS ?v) WHERE {_PARTS}", f"SELECT {_P} p_partkey AS p, {sql} AS v FROM part")


def _filter(test: str, sql: str) -> tuple[str, str]:
    """A filter over orders."""
    return _q(
        f"SELECT ?o WHERE {{ ?o a :Order ; :status ?s ; :totalPrice ?t ; :priority ?y ; :orderDate ?d ; :customer ?c . FILTER({test}) }}",
        f"SELECT {_O} o_orderkey AS o FROM orders WHERE {sql}",
    )


QUERIES: dict[str, tuple[str, str]] = {
    # -- scans and joins
    "bgp_single": _q("SELECT ?o ?t WHERE { ?o :totalPrice ?t }", f"SELECT {_O} o_orderkey AS o, o_totalprice AS t FROM orders"),
    "bgp_star": _q("SELECT ?o ?s ?t ?y WHERE { ?o :status ?s ; :totalPrice ?t ; :priority ?y }", f"SELECT {_O} o_orderkey AS o, o_orderstatus AS s, o_totalprice AS t, o_orderpriority AS y FROM orders"),
    "bgp_chain": _q("SELECT ?o ?rn WHERE { ?o :customer ?c . ?c :nation ?n . ?n :region ?r . ?r :name ?rn }", f"SELECT {_O} o_orderkey AS o, r_name AS rn FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "bgp_snowflake": _q(
        "SELECT ?q ?pn ?sn ?y WHERE { ?l :quantity ?q ; :order ?o ; :part ?p ; :supplier ?s . ?p :name ?pn . ?s a :Supplier ; :name ?sn . ?o :priority ?y }",
        "SELECT l_quantity AS q, p_name AS pn, s_name AS sn, o_orderpriority AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey",
    ),
    "bgp_const_object": _q('SELECT ?o WHERE { ?o :priority "1-URGENT" ; :status "F" }', f"SELECT {_O} o_orderkey AS o FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'"),
    "bgp_const_subject": _q("SELECT ?n ?r WHERE { <http://ex/nation/3> :name ?n ; :region ?r }", f"SELECT n_name AS n, {_R} n_regionkey AS r FROM nation WHERE n_nationkey = 3"),
    "bgp_const_node": _q("SELECT ?c WHERE { ?c a :Customer ; :nation <http://ex/nation/7> }", f"SELECT {_C} c_custkey AS c FROM customer WHERE c_nationkey = 7"),
    "bgp_constant_gate": _q('SELECT ?r WHERE { ?r a :Region . <http://ex/nation/3> :name "NATION_3" }', f"SELECT {_R} r_regionkey AS r FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 3 AND n_name = 'NATION_3')"),
    "bgp_pred_var": _q("SELECT ?s ?p ?o WHERE { ?s a :Nation ; ?p ?o }", _NATION_TERMS.replace("SELECT '<http://ex/nation/' || n_nationkey || '>'", f"SELECT {_N} n_nationkey")),
    "bgp_type_var": _q("SELECT ?t (COUNT(*) AS ?n) WHERE { ?s a ?t ; :name ?x } GROUP BY ?t", "SELECT t, count(*) AS n FROM (SELECT 'http://ex/Region' AS t FROM region UNION ALL SELECT 'http://ex/Nation' FROM nation UNION ALL SELECT 'http://ex/Customer' FROM customer UNION ALL SELECT 'http://ex/Supplier' FROM supplier UNION ALL SELECT 'http://ex/Part' FROM part) GROUP BY t"),
    "bgp_many_tables": _q("SELECT ?x ?n WHERE { ?x :acctbal ?b ; :name ?n FILTER(?b > 5000) }", f"SELECT '<' || {_C} c_custkey || '>' AS x, c_name AS n FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT '<' || {_S} s_suppkey || '>', s_name FROM supplier WHERE s_acctbal > 5000"),
    "bgp_split_subject": _q("SELECT ?d ?l ?q WHERE { ?d :lang ?l ; :quality ?q }", "SELECT 'http://ex/documents/' || d.doc_id AS d, lang AS l, quality AS q FROM documents d JOIN labels USING (doc_id)"),
    "bgp_cross_product": _q("SELECT ?a ?b WHERE { ?a a :Region . ?b a :Nation }", f"SELECT {_R} r_regionkey AS a, {_N} n_nationkey AS b FROM region, nation"),
    "bgp_shared_object": _q("SELECT ?a ?b WHERE { ?a a :Supplier ; :nation ?n . ?b a :Supplier ; :nation ?n FILTER(?a != ?b) }", f"SELECT {_S} a.s_suppkey AS a, {_S} b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey"),
    "bgp_cycle": _q(
        "SELECT ?o ?s WHERE { ?o :customer ?c . ?c :nation ?n . ?l :order ?o ; :supplier ?s . ?s a :Supplier ; :nation ?n }",
        f"SELECT {_O} o_orderkey AS o, {_S} s_suppkey AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey",
    ),
    "bgp_blank_node": _q("SELECT ?n WHERE { ?c :nation [ :name ?n ] ; :segment \"BUILDING\" }", "SELECT n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'"),
    # -- filters
    "f_eq": _filter('?s = "F"', "o_orderstatus = 'F'"),
    "f_ne": _filter('?s != "F"', "o_orderstatus <> 'F'"),
    "f_lt": _filter("?t < 50000", "o_totalprice < 50000"),
    "f_range": _filter("?t >= 50000 && ?t <= 90000.5", "o_totalprice BETWEEN 50000 AND 90000.5"),
    "f_and_or": _filter('(?s = "F" && ?t > 300000) || ?y = "5-LOW" || ?t < 1000', "(o_orderstatus = 'F' AND o_totalprice > 300000) OR o_orderpriority = '5-LOW' OR o_totalprice < 1000"),
    "f_not": _filter('!(?s = "O")', "NOT o_orderstatus = 'O'"),
    "f_in": _filter('?s IN ("F", "P")', "o_orderstatus IN ('F', 'P')"),
    "f_not_in": _filter('?s NOT IN ("F", "P")', "o_orderstatus NOT IN ('F', 'P')"),
    "f_arith": _filter("?t * 2 - 1000 > 600000 + 100", "o_totalprice * 2 - 1000 > 600100"),
    "f_regex": _filter('regex(?y, "^[12]-")', "regexp_matches(o_orderpriority, '^[12]-')"),
    "f_regex_i": _filter('regex(?y, "urgent", "i")', "regexp_matches(o_orderpriority, 'urgent', 'i')"),
    "f_contains": _filter('contains(?y, "IG")', "contains(o_orderpriority, 'IG')"),
    "f_strstarts": _filter('strstarts(?y, "3")', "starts_with(o_orderpriority, '3')"),
    "f_strends": _filter('strends(?y, "W")', "ends_with(o_orderpriority, 'W')"),
    "f_date": _filter('?d >= "1998-01-01T00:00:00"^^xsd:dateTime', "o_orderdate >= TIMESTAMP '1998-01-01'"),
    "f_isnumeric": _filter("isNumeric(?t) && !isNumeric(?s)", "true"),
    "f_isiri": _filter("isIRI(?c) && !isIRI(?t) && isIRI(?o)", "true"),
    "f_isliteral": _filter("isLiteral(?t) && !isLiteral(?c)", "true"),
    "f_isblank": _filter("isBlank(?c)", "false"),
    "f_datatype": _filter(f"datatype(?t) = <{_DOUBLE}> && datatype(?s) = xsd:string", "true"),
    "f_lang": _filter('lang(?s) = ""', "true"),
    "f_langmatches": _filter('langMatches(lang(?s), "*")', "false"),
    "f_sameterm": _q("SELECT ?a WHERE { ?a :nation ?n . ?a a :Supplier . ?b a :Customer ; :nation ?m FILTER(sameTerm(?n, ?m) && ?b = <http://ex/customer/5>) }", f"SELECT {_S} s_suppkey AS a FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_custkey = 5"),
    "f_mixed_types": _filter('?t = "x" || ?s > 5', "false"),
    "f_bound": _q("SELECT ?o WHERE { ?o a :Order OPTIONAL { ?l :order ?o ; :quantity ?q FILTER(?q > 49) } FILTER(bound(?q)) }", f"SELECT {_O} o_orderkey AS o FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 49"),
    "f_not_bound": _q("SELECT ?o WHERE { ?o a :Order OPTIONAL { ?l :order ?o } FILTER(!bound(?l)) }", f"SELECT {_O} o_orderkey AS o FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"),
    "f_exists": _q("SELECT ?o WHERE { ?o a :Order FILTER EXISTS { ?l :order ?o ; :quantity ?q FILTER(?q > 49) } }", f"SELECT {_O} o_orderkey AS o FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)"),
    "f_not_exists": _q("SELECT ?o WHERE { ?o a :Order FILTER NOT EXISTS { ?l :order ?o } }", f"SELECT {_O} o_orderkey AS o FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    "f_exists_in_or": _q('SELECT ?o WHERE { ?o a :Order ; :status ?s FILTER(?s = "P" || NOT EXISTS { ?l :order ?o }) }', f"SELECT {_O} o_orderkey AS o FROM orders WHERE o_orderstatus = 'P' OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    "f_three_valued": _q("SELECT ?d WHERE { ?d :lang ?l OPTIONAL { ?d :quality ?q } FILTER(?q > 0 || ?l = \"de\") }", "SELECT 'http://ex/documents/' || d.doc_id AS d FROM documents d LEFT JOIN labels USING (doc_id) WHERE quality > 0 OR lang = 'de'"),
    # -- functions
    "fn_str": _function("str(?p)", f"{_P} p_partkey"),
    "fn_strlen": _function("strlen(?n)", "length(p_name)"),
    "fn_substr": _function("substr(?n, 2, 3)", "substr(p_name, 2, 3)"),
    "fn_ucase": _function("ucase(?n)", "upper(p_name)"),
    "fn_lcase": _function("lcase(ucase(?n))", "lower(p_name)"),
    "fn_concat": _function('concat(?n, "-", str(?z))', "p_name || '-' || p_size"),
    "fn_contains": _function('contains(?n, "red")', "contains(p_name, 'red')"),
    "fn_strbefore": _function('strbefore(?n, " ")', "CASE WHEN contains(p_name, ' ') THEN split_part(p_name, ' ', 1) ELSE '' END"),
    "fn_strafter": _function('strafter(?n, " ")', "CASE WHEN contains(p_name, ' ') THEN substr(p_name, instr(p_name, ' ') + 1) ELSE '' END"),
    "fn_replace": _function('replace(?n, "[aeiou]", "_")', "regexp_replace(p_name, '[aeiou]', '_', 'g')"),
    "fn_abs": _function("abs(?z - 25)", "CAST(abs(p_size - 25) AS BIGINT)"),
    "fn_ceil_floor_round": _function("ceil(?r) + floor(?r) * 2 + round(?r) * 4", "ceil(p_retailprice) + floor(p_retailprice) * 2 + floor(p_retailprice + 0.5) * 4"),
    "fn_year_month_day": _q("SELECT ?o (year(?d) AS ?y) (month(?d) AS ?m) (day(?d) AS ?k) WHERE { ?o :orderDate ?d }", f"SELECT {_O} o_orderkey AS o, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS k FROM orders"),
    "fn_hours_minutes_seconds": _q("SELECT ?e (hours(?d) AS ?h) (minutes(?d) AS ?m) WHERE { ?e :at ?d }", f"SELECT {_E} event_id AS e, hour(ts) AS h, minute(ts) AS m FROM events"),
    "fn_if": _function('if(?z > 25, "big", "small")', "CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END"),
    "fn_coalesce": _q("SELECT ?d (coalesce(?q, -1) AS ?v) WHERE { ?d :lang ?l OPTIONAL { ?d :quality ?q } }", "SELECT 'http://ex/documents/' || d.doc_id AS d, CAST(coalesce(quality, -1) AS BIGINT) AS v FROM documents d LEFT JOIN labels USING (doc_id)"),
    "fn_md5": _function("md5(?n)", "md5(p_name)"),
    "fn_sha256": _function("sha256(?n)", "sha256(p_name)"),
    "fn_encode_uri": _function('encode_for_uri(concat(?n, "/ü&"))', "replace(p_name, ' ', '%20') || '%2F%C3%BC%26'"),
    "fn_arith": _function("(?r - ?z) / 4 + ?z * 3 - -1", "(p_retailprice - p_size) / 4 + p_size * 3 + 1"),
    "fn_divide_zero": _function("?z / (?z - ?z)", "CAST(NULL AS DOUBLE)"),
    "fn_left_associative": _function("?z - 3 - 2", "CAST(p_size - 3 - 2 AS BIGINT)"),
    "fn_cast": _function("xsd:integer(?r)", "CAST(trunc(p_retailprice) AS BIGINT)"),
    "fn_iri": _function('iri(concat("http://ex/x/", str(?z)))', "'http://ex/x/' || p_size"),
    "fn_strdt_strlang": _function('concat(lang(strlang(?n, "en")), str(datatype(strdt(?n, xsd:integer))))', f"'en{_INT}'"),
    # -- group patterns
    "optional": _q("SELECT ?o ?q WHERE { ?o a :Order OPTIONAL { ?l :order ?o ; :quantity ?q } }", f"SELECT {_O} o_orderkey AS o, l_quantity AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey"),
    "optional_filter": _q("SELECT ?o ?q WHERE { ?o a :Order ; :totalPrice ?t OPTIONAL { ?l :order ?o ; :quantity ?q FILTER(?q * 5000 > ?t) } }", f"SELECT {_O} o_orderkey AS o, l_quantity AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity * 5000 > o_totalprice"),
    "optional_nested": _q("SELECT ?n ?c ?o WHERE { ?n a :Nation OPTIONAL { ?c a :Customer ; :nation ?n OPTIONAL { ?o :customer ?c ; :status \"P\" } } }", f"SELECT {_N} n_nationkey AS n, {_C} c_custkey AS c, {_O} o_orderkey AS o FROM nation LEFT JOIN (customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P') ON c_nationkey = n_nationkey"),
    "optional_rejoined": _q("SELECT ?d ?q WHERE { ?d :lang \"es\" OPTIONAL { ?d :quality ?q } { SELECT DISTINCT ?q WHERE { ?x :quality ?q ; :toxic 1 } } }", "SELECT 'http://ex/documents/' || d.doc_id AS d, z.q AS q FROM documents d LEFT JOIN labels l USING (doc_id) JOIN (SELECT DISTINCT quality AS q FROM labels WHERE toxic = 1) z ON l.quality = z.q OR l.quality IS NULL WHERE lang = 'es'"),
    "union": _q("SELECT ?x WHERE { { ?x a :Nation } UNION { ?x a :Region } UNION { ?x a :Nation } }", "SELECT '<http://ex/nation/' || n_nationkey || '>' AS x FROM nation UNION ALL SELECT '<http://ex/region/' || r_regionkey || '>' FROM region UNION ALL SELECT '<http://ex/nation/' || n_nationkey || '>' FROM nation"),
    "union_disjoint": _q("SELECT ?a ?b WHERE { { ?x a :Nation ; :name ?a } UNION { ?y a :Region ; :name ?b } }", "SELECT n_name AS a, NULL AS b FROM nation UNION ALL SELECT NULL, r_name FROM region"),
    "minus": _q("SELECT ?o WHERE { ?o a :Order MINUS { ?l :order ?o } }", f"SELECT {_O} o_orderkey AS o FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"),
    "minus_disjoint": _q("SELECT ?r WHERE { ?r a :Region MINUS { ?n a :Nation } }", f"SELECT {_R} r_regionkey AS r FROM region"),
    "minus_empty": _q('SELECT ?r WHERE { ?r a :Region MINUS { ?r :name "NOWHERE" } }', f"SELECT {_R} r_regionkey AS r FROM region"),
    "minus_nested": _q('SELECT ?c WHERE { ?c a :Customer MINUS { ?o :customer ?c ; :status ?s MINUS { ?o :status "F" } } }', f"SELECT {_C} c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F')"),
    "nested_group": _q("SELECT ?c ?n WHERE { ?c a :Customer ; :nation ?k . { ?k :name ?n FILTER(strends(?n, \"1\")) } }", f"SELECT {_C} c_custkey AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE ends_with(n_name, '1')"),
    "bind": _q("SELECT ?o ?v WHERE { ?o :totalPrice ?t BIND(?t * 2 AS ?v) FILTER(?v > 600000) }", f"SELECT {_O} o_orderkey AS o, o_totalprice * 2 AS v FROM orders WHERE o_totalprice * 2 > 600000"),
    "values": _q('SELECT ?o ?s WHERE { VALUES ?s { "F" "P" } ?o :status ?s }', f"SELECT {_O} o_orderkey AS o, o_orderstatus AS s FROM orders WHERE o_orderstatus IN ('F', 'P')"),
    "values_undef": _q('SELECT ?o ?s ?y WHERE { ?o :status ?s ; :priority ?y . VALUES (?s ?y) { ("F" UNDEF) (UNDEF "5-LOW") } }', f"SELECT {_O} o_orderkey AS o, o_orderstatus AS s, o_orderpriority AS y FROM orders JOIN (VALUES ('F', NULL), (NULL, '5-LOW')) v(a, b) ON (a IS NULL OR a = o_orderstatus) AND (b IS NULL OR b = o_orderpriority)"),
    "subselect": _q("SELECT ?c ?m WHERE { ?c a :Customer { SELECT ?c (MAX(?t) AS ?m) WHERE { ?o :customer ?c ; :totalPrice ?t } GROUP BY ?c } }", f"SELECT {_C} o_custkey AS c, max(o_totalprice) AS m FROM orders GROUP BY o_custkey"),
    "ask_true": _q('ASK { ?n :name "NATION_3" }', "SELECT true AS _askResult"),
    "ask_false": _q('ASK { ?n :name "NOWHERE" }', "SELECT false AS _askResult"),
    "distinct": _q("SELECT DISTINCT ?s ?y WHERE { ?o :status ?s ; :priority ?y }", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS y FROM orders"),
    "reduced": _q("SELECT REDUCED ?s WHERE { ?o a :Order ; :status ?s }", "SELECT o_orderstatus AS s FROM orders"),
    "select_star": _q("SELECT * WHERE { ?n :region ?r ; :name ?x }", f"SELECT {_N} n_nationkey AS n, {_R} n_regionkey AS r, n_name AS x FROM nation"),
    "select_unbound": _q("SELECT ?r ?zz WHERE { ?r a :Region }", f"SELECT {_R} r_regionkey AS r, CAST(NULL AS VARCHAR) AS zz FROM region"),
    "construct": _q("CONSTRUCT { ?r :hasNation ?n } WHERE { ?n :region ?r }", "SELECT '<http://ex/region/' || n_regionkey || '>' AS s, '<http://ex/hasNation>' AS p, '<http://ex/nation/' || n_nationkey || '>' AS o FROM nation"),
    # -- aggregates
    "count_star": _q("SELECT (COUNT(*) AS ?n) WHERE { ?o a :Order }", "SELECT count(*) AS n FROM orders"),
    "count_var": _q("SELECT (COUNT(?q) AS ?n) (COUNT(?d) AS ?m) WHERE { ?d :lang ?l OPTIONAL { ?d :quality ?q } }", "SELECT count(quality) AS n, count(*) AS m FROM documents LEFT JOIN labels USING (doc_id)"),
    "count_distinct": _q("SELECT ?s (COUNT(DISTINCT ?c) AS ?n) WHERE { ?o :status ?s ; :customer ?c } GROUP BY ?s", "SELECT o_orderstatus AS s, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1"),
    "count_distinct_star": _q("SELECT (COUNT(DISTINCT *) AS ?n) WHERE { ?o :status ?s }", "SELECT count(*) AS n FROM orders"),
    "sum": _q("SELECT ?s (ROUND(SUM(?t) * 100) / 100 AS ?v) WHERE { ?o :status ?s ; :totalPrice ?t } GROUP BY ?s", "SELECT o_orderstatus AS s, floor(sum(o_totalprice) * 100 + 0.5) / 100 AS v FROM orders GROUP BY 1"),
    "sum_int": _q("SELECT (SUM(?z) AS ?v) WHERE { ?p :size ?z }", "SELECT CAST(sum(p_size) AS BIGINT) AS v FROM part"),
    "avg": _q("SELECT ?y (ROUND(AVG(?t) * 1000) / 1000 AS ?v) WHERE { ?o :priority ?y ; :totalPrice ?t } GROUP BY ?y", "SELECT o_orderpriority AS y, floor(avg(o_totalprice) * 1000 + 0.5) / 1000 AS v FROM orders GROUP BY 1"),
    "min": _q("SELECT ?s (MIN(?t) AS ?v) (MIN(?d) AS ?w) WHERE { ?o :status ?s ; :totalPrice ?t ; :orderDate ?d } GROUP BY ?s", "SELECT o_orderstatus AS s, min(o_totalprice) AS v, min(o_orderdate) AS w FROM orders GROUP BY 1"),
    "max": _q("SELECT ?s (MAX(?t) AS ?v) (MAX(?y) AS ?w) WHERE { ?o :status ?s ; :totalPrice ?t ; :priority ?y } GROUP BY ?s", "SELECT o_orderstatus AS s, max(o_totalprice) AS v, max(o_orderpriority) AS w FROM orders GROUP BY 1"),
    "sum_distinct": _q("SELECT (SUM(DISTINCT ?z) AS ?v) (AVG(DISTINCT ?z) AS ?w) WHERE { ?p :size ?z }", "SELECT CAST(sum(DISTINCT p_size) AS BIGINT) AS v, avg(DISTINCT p_size) AS w FROM part"),
    "sample": _q("SELECT ?s (SAMPLE(?s) AS ?v) WHERE { ?o :status ?s } GROUP BY ?s", "SELECT o_orderstatus AS s, o_orderstatus AS v FROM orders GROUP BY 1"),
    "group_concat": _q('SELECT ?r (GROUP_CONCAT(?x; SEPARATOR=",") AS ?v) WHERE { ?n :region ?r ; :name ?x } GROUP BY ?r', f"SELECT {_R} n_regionkey AS r, string_agg(n_name, ',' ORDER BY n_name) AS v FROM nation GROUP BY n_regionkey"),
    "group_multi": _q("SELECT ?s ?y (COUNT(*) AS ?n) WHERE { ?o :status ?s ; :priority ?y } GROUP BY ?s ?y", "SELECT o_orderstatus AS s, o_orderpriority AS y, count(*) AS n FROM orders GROUP BY 1, 2"),
    "group_expr": _q("SELECT ?y (COUNT(*) AS ?n) WHERE { ?o :orderDate ?d } GROUP BY (year(?d) AS ?y)", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1"),
    "having": _q(
        "SELECT ?x (COUNT(?o) AS ?cnt) (ROUND(SUM(?p) * 100) / 100 AS ?tot) WHERE { ?o :customer ?c ; :totalPrice ?p . ?c :nation ?k . ?k :name ?x FILTER(?p > 1000) } GROUP BY ?x HAVING(COUNT(?o) > 10)",
        "SELECT n_name AS x, count(*) AS cnt, floor(sum(o_totalprice) * 100 + 0.5) / 100 AS tot FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 1000 GROUP BY 1 HAVING count(*) > 10",
    ),
    "agg_empty": _q('SELECT (COUNT(?o) AS ?n) (SUM(?t) AS ?v) WHERE { ?o :status "X" ; :totalPrice ?t }', "SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS v"),
    # -- order and slices
    "order_asc": _q("SELECT ?o ?t WHERE { ?o :totalPrice ?t } ORDER BY ?t ?o LIMIT 20", f"SELECT {_O} o_orderkey AS o, o_totalprice AS t FROM orders ORDER BY t, o LIMIT 20"),
    "order_desc": _q("SELECT ?o ?t WHERE { ?o :totalPrice ?t } ORDER BY DESC(?t) ?o LIMIT 20", f"SELECT {_O} o_orderkey AS o, o_totalprice AS t FROM orders ORDER BY t DESC, o LIMIT 20"),
    "order_multi": _q("SELECT ?y ?s ?o WHERE { ?o :priority ?y ; :status ?s } ORDER BY DESC(?y) ?s DESC(?o) LIMIT 25", f"SELECT o_orderpriority AS y, o_orderstatus AS s, {_O} o_orderkey AS o FROM orders ORDER BY y DESC, s, o DESC LIMIT 25"),
    "order_expr": _q("SELECT ?p WHERE { ?p :size ?z ; :retailPrice ?r } ORDER BY DESC(?r - 10 * ?z) ?p LIMIT 10", f"SELECT {_P} p_partkey AS p FROM part ORDER BY p_retailprice - 10 * p_size DESC, p LIMIT 10"),
    "order_unbound_first": _q("SELECT ?d ?q WHERE { ?d :lang ?l OPTIONAL { ?d :quality ?q } } ORDER BY ?q ?d LIMIT 15", "SELECT 'http://ex/documents/' || d.doc_id AS d, quality AS q FROM documents d LEFT JOIN labels USING (doc_id) ORDER BY q NULLS FIRST, d LIMIT 15"),
    "offset": _q("SELECT ?o ?t WHERE { ?o :totalPrice ?t } ORDER BY ?t ?o LIMIT 10 OFFSET 30", f"SELECT {_O} o_orderkey AS o, o_totalprice AS t FROM orders ORDER BY t, o LIMIT 10 OFFSET 30"),
    "distinct_order_limit": _q("SELECT DISTINCT ?y WHERE { ?o :priority ?y } ORDER BY DESC(?y) LIMIT 3", "SELECT DISTINCT o_orderpriority AS y FROM orders ORDER BY y DESC LIMIT 3"),
    "limit_no_order": _q("SELECT (COUNT(*) AS ?n) WHERE { { SELECT ?o WHERE { ?o a :Order } LIMIT 17 } }", "SELECT CAST(17 AS BIGINT) AS n"),
    # -- paths
    "prop_seq": _q("SELECT ?c ?x WHERE { ?c a :Customer . ?c :nation/:region/:name ?x }", "SELECT 'http://ex/customer/' || c_custkey AS c, '\"' || r_name || '\"' AS x FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey".replace("'http://ex/customer/' || c_custkey AS c", "'<http://ex/customer/' || c_custkey || '>' AS c")),
    "prop_alt": _q("SELECT ?x WHERE { <http://ex/nation/3> :region|:name ?x }", "SELECT '<http://ex/region/' || n_regionkey || '>' AS x FROM nation WHERE n_nationkey = 3 UNION ALL SELECT '\"' || n_name || '\"' FROM nation WHERE n_nationkey = 3"),
    "prop_inv": _q("SELECT ?n WHERE { <http://ex/region/1> ^:region ?n }", "SELECT '<http://ex/nation/' || n_nationkey || '>' AS n FROM nation WHERE n_regionkey = 1"),
    "prop_plus": _q("SELECT ?x WHERE { <http://ex/customer/5> (:nation|:region)+ ?x }", "SELECT '<http://ex/nation/' || c_nationkey || '>' AS x FROM customer WHERE c_custkey = 5 UNION ALL SELECT '<http://ex/region/' || n_regionkey || '>' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 5"),
    "prop_star": _q("SELECT ?x WHERE { <http://ex/customer/5> (:nation|:region)* ?x }", "SELECT '<http://ex/customer/5>' AS x UNION ALL SELECT '<http://ex/nation/' || c_nationkey || '>' FROM customer WHERE c_custkey = 5 UNION ALL SELECT '<http://ex/region/' || n_regionkey || '>' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 5"),
    "prop_opt": _q("SELECT ?x WHERE { <http://ex/nation/3> :region? ?x }", "SELECT '<http://ex/nation/3>' AS x UNION ALL SELECT '<http://ex/region/' || n_regionkey || '>' FROM nation WHERE n_nationkey = 3"),
    "prop_neg": _q(f"SELECT ?x WHERE {{ <http://ex/nation/3> !(:region|<{RDF_TYPE}>) ?x }}", "SELECT '\"' || n_name || '\"' AS x FROM nation WHERE n_nationkey = 3"),
    "shortest_path": _q(
        "SELECT ?c (shortestPath(?c, <http://ex/region/1>, true, {:nation, :region}) AS ?v) WHERE { ?c a :Customer }",
        "SELECT '<http://ex/customer/' || c_custkey || '>' AS c, CASE WHEN n_regionkey = 1 THEN '<http://ex/customer/' || c_custkey || '> <http://ex/nation> <http://ex/nation/' || c_nationkey || '> <http://ex/region> <http://ex/region/1>' END AS v FROM customer JOIN nation ON c_nationkey = n_nationkey",
    ),
    "shortest_path_len": _q("SELECT ?c (shortestPathLen(?c, <http://ex/region/1>, true, {:nation, :region}) AS ?v) WHERE { ?c a :Customer }", "SELECT '<http://ex/customer/' || c_custkey || '>' AS c, CASE WHEN n_regionkey = 1 THEN CAST(2 AS BIGINT) END AS v FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "khop_reachable": _q("SELECT ?a (kHopReachable(?a, <http://ex/nation/3>, false, 2, {:region}) AS ?v) WHERE { ?a a :Nation }", "SELECT '<http://ex/nation/' || a.n_nationkey || '>' AS a, a.n_regionkey = b.n_regionkey AS v FROM nation a, nation b WHERE b.n_nationkey = 3"),
    "khop_filter": _q("SELECT ?s WHERE { ?s a :Supplier FILTER(kHopReachable(?s, <http://ex/region/1>, true, 2, {:nation, :region})) }", "SELECT '<http://ex/supplier/' || s_suppkey || '>' AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1"),
    "khop_enumerate": _q("SELECT ?a (kHopEnumerate(?a, <http://ex/nation/3>, false, 2, {:region}) AS ?v) WHERE { ?a a :Nation }", "SELECT '<http://ex/nation/' || a.n_nationkey || '>' AS a, CASE WHEN a.n_regionkey = b.n_regionkey AND a.n_nationkey <> 3 THEN '<http://ex/nation/' || a.n_nationkey || '> <http://ex/region> <http://ex/region/' || a.n_regionkey || '> <http://ex/region> <http://ex/nation/3>' END AS v FROM nation a, nation b WHERE b.n_nationkey = 3"),
    "cycle_boolean": _q("SELECT ?a (cycleBoolean(?a, <http://ex/nation/3>, false, {:region}) AS ?v) WHERE { ?a a :Nation }", "SELECT '<http://ex/nation/' || a.n_nationkey || '>' AS a, a.n_regionkey = b.n_regionkey AND a.n_nationkey <> 3 AS v FROM nation a, nation b WHERE b.n_nationkey = 3"),
    "cycle_path": _q("SELECT ?a (cyclePath(?a, <http://ex/region/1>, false, {:region}) AS ?v) WHERE { ?a a :Nation }", "SELECT '<http://ex/nation/' || n_nationkey || '>' AS a, CASE WHEN n_regionkey = 1 THEN '<http://ex/nation/' || n_nationkey || '> <http://ex/region> <http://ex/region/1> <http://ex/region> <http://ex/nation/' || n_nationkey || '>' END AS v FROM nation"),
    "simple_cycle": _q("SELECT ?a (simpleCycleBoolean(?a, <http://ex/region/1>, false, 4, {:region}) AS ?v) WHERE { ?a a :Nation }", "SELECT '<http://ex/nation/' || n_nationkey || '>' AS a, false AS v FROM nation"),
    # -- top-k
    "topk_single": _q("SELECT ?o ?t WHERE { ?o :totalPrice ?t } ORDER BY DESC(?t) ?o LIMIT 5", f"SELECT {_O} o_orderkey AS o, o_totalprice AS t FROM orders ORDER BY t DESC, o LIMIT 5"),
    "topk_chain": _q("SELECT ?o ?b ?t WHERE { ?o :customer ?c ; :totalPrice ?t . ?c :acctbal ?b } ORDER BY DESC(?t + ?b) ?o LIMIT 5", f"SELECT {_O} o_orderkey AS o, c_acctbal AS b, o_totalprice AS t FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice + c_acctbal DESC, o LIMIT 5"),
    "topk_diff": _q("SELECT ?o ?b ?t WHERE { ?o :customer ?c ; :totalPrice ?t . ?c :acctbal ?b } ORDER BY ?t - ?b ?o LIMIT 5", f"SELECT {_O} o_orderkey AS o, c_acctbal AS b, o_totalprice AS t FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice - c_acctbal, o LIMIT 5"),
    "topk_weighted": _q("SELECT ?o ?q WHERE { ?l :order ?o ; :quantity ?q ; :extendedPrice ?e . ?o :totalPrice ?t } ORDER BY DESC(2 * ?e + 0.5 * ?t) ?o ?q LIMIT 5", f"SELECT {_O} o_orderkey AS o, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey ORDER BY 2 * l_extendedprice + 0.5 * o_totalprice DESC, o, q LIMIT 5"),
    "topk_fanout": _q("SELECT ?o ?e ?t WHERE { ?o :totalPrice ?t . ?l :order ?o ; :extendedPrice ?e } ORDER BY DESC(?t + ?e) ?o ?e LIMIT 20", f"SELECT {_O} o_orderkey AS o, l_extendedprice AS e, o_totalprice AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey ORDER BY o_totalprice + l_extendedprice DESC, o, e LIMIT 20"),
    "topk_star": _q("SELECT ?c ?t ?u WHERE { ?o :customer ?c ; :totalPrice ?t . ?x :customer ?c ; :totalPrice ?u . ?c :segment \"BUILDING\" } ORDER BY DESC(?t + ?u) ?c ?t ?u LIMIT 10", f"SELECT {_C} c_custkey AS c, a.o_totalprice AS t, b.o_totalprice AS u FROM customer JOIN orders a ON a.o_custkey = c_custkey JOIN orders b ON b.o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' ORDER BY t + u DESC, c, t, u LIMIT 10"),
    "topk_cycle": _q(
        "SELECT ?o ?s ?b ?t WHERE { ?o :customer ?c ; :totalPrice ?t . ?c :nation ?n . ?l :order ?o ; :supplier ?s . ?s a :Supplier ; :nation ?n ; :acctbal ?b } ORDER BY DESC(?t + ?b) ?o ?s LIMIT 20",
        f"SELECT {_O} o_orderkey AS o, {_S} s_suppkey AS s, s_acctbal AS b, o_totalprice AS t FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey ORDER BY o_totalprice + s_acctbal DESC, o, s LIMIT 20",
    ),
    "topk_nonnumeric": _q("SELECT ?o ?s WHERE { ?o :status ?s } ORDER BY DESC(?s) ?o LIMIT 5", f"SELECT {_O} o_orderkey AS o, o_orderstatus AS s FROM orders WHERE false"),
    "topk_offset": _q("SELECT ?o ?e ?t WHERE { ?o :totalPrice ?t . ?l :order ?o ; :extendedPrice ?e } ORDER BY DESC(?t + ?e) ?o ?e LIMIT 5 OFFSET 5", f"SELECT {_O} o_orderkey AS o, l_extendedprice AS e, o_totalprice AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey ORDER BY o_totalprice + l_extendedprice DESC, o, e LIMIT 5 OFFSET 5"),
}


# -- variables that may be unbound
QUERIES |= {
    "optional_chain": _q(
        "SELECT ?o ?s ?b WHERE { ?o a :Order ; :status \"P\" OPTIONAL { ?l :order ?o ; :supplier ?s } OPTIONAL { ?s a :Supplier ; :acctbal ?b } }",
        f"SELECT {_O} o_orderkey AS o, {_S} s_suppkey AS s, s_acctbal AS b FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey OR l_suppkey IS NULL WHERE o_orderstatus = 'P'",
    ),
    "optional_unbound_filter": _q(
        "SELECT ?d ?x WHERE { ?d a :Document OPTIONAL { ?d :quality ?q } OPTIONAL { ?x :vecLabel ?q . FILTER(?x = <http://ex/embeddings/7> || ?x = <http://ex/embeddings/8>) } }",
        "SELECT 'http://ex/documents/' || d.doc_id AS d, 'http://ex/embeddings/' || vec_id AS x FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT * FROM embeddings WHERE vec_id IN (7, 8)) e ON label = quality OR quality IS NULL",
    ),
    "minus_unbound": _q(
        "SELECT ?c ?p WHERE { ?c a :Customer OPTIONAL { ?o :customer ?c ; :status \"P\" ; :priority ?p } MINUS { ?x a :Order ; :priority ?p ; :totalPrice ?t FILTER(?t > 497000) } }",
        f"SELECT {_C} c_custkey AS c, o_orderpriority AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE o_orderpriority IS NULL OR o_orderpriority NOT IN (SELECT o_orderpriority FROM orders WHERE o_totalprice > 497000)",
    ),
    "exists_unbound": _q(
        "SELECT ?c ?p WHERE { ?c a :Customer OPTIONAL { ?o :customer ?c ; :status \"P\" ; :priority ?p } FILTER EXISTS { ?x a :Order ; :priority ?p ; :totalPrice ?t FILTER(?t > 497000) } }",
        f"SELECT {_C} c_custkey AS c, o_orderpriority AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE EXISTS (SELECT 1 FROM orders x WHERE x.o_totalprice > 497000 AND (x.o_orderpriority = orders.o_orderpriority OR orders.o_orderpriority IS NULL))",
    ),
    "not_exists_unbound": _q(
        "SELECT ?c ?p WHERE { ?c a :Customer OPTIONAL { ?o :customer ?c ; :status \"P\" ; :priority ?p } FILTER NOT EXISTS { ?x a :Part ; :size 0 . ?y :priority ?p } }",
        f"SELECT {_C} c_custkey AS c, o_orderpriority AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'",
    ),
    "exists_twice": _q(
        "SELECT ?c WHERE { ?c a :Customer ; :nation ?n FILTER(EXISTS { ?o :customer ?c ; :status \"P\" } || !EXISTS { ?s a :Supplier ; :nation ?n }) }",
        f"SELECT {_C} c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') OR NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey)",
    ),
    "exists_projected": _q(
        "SELECT ?c ?v WHERE { ?c a :Customer ; :acctbal ?b BIND(EXISTS { ?o :customer ?c ; :totalPrice ?t FILTER(?t > 45 * ?b) } AS ?v) }",
        f"SELECT {_C} c_custkey AS c, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 45 * c_acctbal) AS v FROM customer",
    ),
}
_EAST = 'IF(?z > 25, "2011-01-10T14:45:13.25-05:30", "2011-01-10T14:45:13Z")'
# -- functions whose values differ by row
QUERIES |= {
    "f_substr_below_one": _function("substr(?n, 0, ?z / 10)", "CASE WHEN round(p_size / 10.0) > 1 THEN substr(p_name, 1, CAST(floor(p_size / 10.0 + 0.5) AS INT) - 1) ELSE '' END"),
    "f_substr_negative": _function("substr(?n, ?z - 30)", "substr(p_name, greatest(p_size - 30, 1))"),
    "f_sha1": _function("sha1(?n)", "sha1(p_name)"),
    "f_seconds": _function(f"seconds(strdt({_EAST}, xsd:dateTime))", "CAST(CASE WHEN p_size > 25 THEN 13.25 ELSE 13.0 END AS DOUBLE)"),
    "f_hours_in_zone": _function(f"hours(strdt({_EAST}, xsd:dateTime))", "CAST(14 AS BIGINT)"),
    "f_tz": _function(f"tz(strdt({_EAST}, xsd:dateTime))", "CASE WHEN p_size > 25 THEN '-05:30' ELSE 'Z' END"),
    "f_timezone": _function(f"str(timezone(strdt({_EAST}, xsd:dateTime)))", "CASE WHEN p_size > 25 THEN '-PT5H30M' ELSE 'PT0S' END"),
    "f_zones_equal": _function(f"strdt({_EAST}, xsd:dateTime) = \"2011-01-10T20:15:13.25Z\"^^xsd:dateTime", "p_size > 25"),
    "f_zone_order": _filter('?d < "1996-01-01T00:00:00+02:00"^^xsd:dateTime', "o_orderdate < TIMESTAMP '1995-12-31 22:00:00'"),
    "f_cast_boolean": _function("xsd:boolean(?z - 25)", "p_size <> 25"),
    "f_cast_boolean_text": _function('xsd:boolean(IF(?z > 25, "true", IF(?z > 10, "0", "maybe")))', "CASE WHEN p_size > 25 THEN true WHEN p_size > 10 THEN false END"),
    "f_cast_date": _q("SELECT ?o (str(xsd:date(?d)) AS ?v) WHERE { ?o :orderDate ?d }", f"SELECT {_O} o_orderkey AS o, strftime(o_orderdate, '%Y-%m-%d') AS v FROM orders"),
    "f_cast_datetime": _filter('?d >= xsd:dateTime("1997-03-04T05:06:07")', "o_orderdate >= TIMESTAMP '1997-03-04 05:06:07'"),
    "f_tags_kept": _function('IF(lang(ucase(strlang(?n, IF(?z > 25, "en", "de")))) = "en", lcase(strlang(?n, "x")), "none")', "CASE WHEN p_size > 25 THEN lower(p_name) ELSE 'none' END"),
    "f_concat_tags": _function('lang(concat(strlang(?n, "en"), strlang(?n, IF(?z > 25, "en", "de"))))', "CASE WHEN p_size > 25 THEN 'en' ELSE '' END"),
    "f_custom": _function("<http://ex/fn/halved>(?r)", "p_retailprice / 2"),
    "f_struuid": _q("SELECT (COUNT(DISTINCT ?u) AS ?n) WHERE { { SELECT (struuid() AS ?u) WHERE { ?p a :Part } } }", "SELECT count(*) AS n FROM part"),
    "f_uuid": _q('SELECT (COUNT(*) AS ?n) WHERE { ?p a :Part BIND(uuid() AS ?u) FILTER(strstarts(str(?u), "urn:uuid:") && strlen(str(?u)) = 45) }', "SELECT count(*) AS n FROM part"),
    "f_bnode": _q("SELECT (COUNT(DISTINCT ?u) AS ?n) WHERE { ?p a :Part ; :size ?z BIND(bnode(str(?z)) AS ?u) FILTER(isBlank(?u)) }", "SELECT count(DISTINCT p_size) AS n FROM part"),
    "f_rand": _q("SELECT (COUNT(*) AS ?n) WHERE { ?p a :Part BIND(rand() AS ?u) FILTER(?u >= 0 && ?u < 1) }", "SELECT count(*) AS n FROM part"),
    "f_now": _q('SELECT (COUNT(*) AS ?n) WHERE { ?p a :Part FILTER(now() > "2020-01-01T00:00:00"^^xsd:dateTime) }', "SELECT count(*) AS n FROM part"),
    "f_isblank_some": _function("isBlank(IF(?z > 25, bnode(?n), ?p))", "p_size > 25"),
    "f_isliteral_some": _function("isLiteral(IF(?z > 25, ?n, ?p))", "p_size > 25"),
    "f_isnumeric_some": _function("isNumeric(IF(?z > 25, ?n, ?z))", "p_size <= 25"),
    "f_langmatches_some": _function('langMatches(lang(strlang(?n, IF(?z > 25, "en-GB", "de"))), "en")', "p_size > 25"),
}
# -- chains of turns
QUERIES |= {
    "chain_length": _q("SELECT ?b (shortestPathLen(?a, ?b, true, {:next}) AS ?v) WHERE { ?a a :Turn ; :turn 0 ; :conv ?c . ?b :conv ?c }", "SELECT 'http://ex/conversations/' || conv_id || '-' || turn AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS v FROM conversations"),
    "chain_reachable": _q("SELECT ?b (kHopReachable(?a, ?b, true, 3, {:next}) AS ?v) WHERE { ?a a :Turn ; :turn 0 ; :conv ?c . ?b :conv ?c }", "SELECT 'http://ex/conversations/' || conv_id || '-' || turn AS b, turn <= 3 AS v FROM conversations"),
    "chain_backwards": _q("SELECT ?b (shortestPathLen(?b, ?a, false, {:next}) AS ?v) WHERE { ?a a :Turn ; :turn 0 ; :conv ?c . ?b :conv ?c }", "SELECT 'http://ex/conversations/' || conv_id || '-' || turn AS b, turn AS v FROM conversations"),
    "chain_closure": _q("SELECT (COUNT(*) AS ?n) WHERE { ?a :next+ ?b }", "SELECT CAST(sum(k * (k - 1) // 2) AS BIGINT) AS n FROM (SELECT count(*) AS k FROM conversations GROUP BY conv_id)"),
}
# -- paths from every customer
QUERIES |= {
    "khop_enumerate_customers": _q(
        "SELECT ?c (kHopEnumerate(?c, <http://ex/region/1>, true, 2, {:nation, :region}) AS ?v) WHERE { ?c a :Customer }",
        "SELECT 'http://ex/customer/' || c_custkey AS c, CASE WHEN n_regionkey = 1 THEN '<http://ex/customer/' || c_custkey || '> <http://ex/nation> <http://ex/nation/' || n_nationkey || '> <http://ex/region> <http://ex/region/1>' END AS v FROM customer JOIN nation ON c_nationkey = n_nationkey",
    ),
    "cycle_customers": _q("SELECT ?c (cycleBoolean(?c, <http://ex/nation/3>, false, {:nation}) AS ?v) WHERE { ?c a :Customer }", "SELECT 'http://ex/customer/' || c_custkey AS c, c_nationkey = 3 AS v FROM customer"),
    "two_calls": _q(
        "SELECT ?c (shortestPathLen(?c, <http://ex/region/1>, true, {:nation, :region}) AS ?v) (kHopReachable(<http://ex/nation/3>, ?c, false, 1, {:nation}) AS ?w) WHERE { ?c a :Customer }",
        "SELECT 'http://ex/customer/' || c_custkey AS c, CASE WHEN n_regionkey = 1 THEN CAST(2 AS BIGINT) END AS v, c_nationkey = 3 AS w FROM customer JOIN nation ON c_nationkey = n_nationkey",
    ),
}
# -- top-k over longer patterns
QUERIES |= {
    "topk_long_chain": _q(
        "SELECT ?n ?c ?o ?e ?t WHERE { ?l :order ?o ; :extendedPrice ?e . ?o :customer ?c ; :totalPrice ?t . ?c a :Customer ; :nation ?n ; :acctbal ?b } ORDER BY DESC(2 * ?e + ?t + ?b) ?n ?c ?o ?e LIMIT 15",
        f"SELECT {_N} c_nationkey AS n, {_C} c_custkey AS c, {_O} o_orderkey AS o, l_extendedprice AS e, o_totalprice AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey ORDER BY 2 * l_extendedprice + o_totalprice + c_acctbal DESC, n, c, o, e LIMIT 15",
    ),
    "topk_two_arms": _q(
        "SELECT ?n ?a ?b WHERE { ?n a :Nation . ?c a :Customer ; :nation ?n ; :acctbal ?a . ?s a :Supplier ; :nation ?n ; :acctbal ?b } ORDER BY ?a - ?b ?n ?a LIMIT 12",
        f"SELECT {_N} n_nationkey AS n, c_acctbal AS a, s_acctbal AS b FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey ORDER BY c_acctbal - s_acctbal, n, a LIMIT 12",
    ),
}
# -- descriptions
QUERIES["describe"] = _q(
    "DESCRIBE <http://ex/nation/3>",
    f"SELECT * FROM ({_NATION_TERMS}) WHERE s = '<http://ex/nation/3>' UNION ALL SELECT '<http://ex/customer/' || c_custkey || '>', '<http://ex/nation>', '<http://ex/nation/3>' FROM customer WHERE c_nationkey = 3 UNION ALL SELECT '<http://ex/supplier/' || s_suppkey || '>', '<http://ex/nation>', '<http://ex/nation/3>' FROM supplier WHERE s_nationkey = 3",
)


def _texts(sql: str, columns: list[str], others: list[str]) -> str:
    """The columns' terms as texts: without brackets or quotes."""
    return "SELECT " + ", ".join([f"trim({c}, '<>\"') AS {c}" for c in columns] + others) + f" FROM ({sql})"


for _name, _columns in {
    "bgp_pred_var": (["p", "o"], ["s"]),
    "bgp_many_tables": (["x"], ["n"]),
    "union": (["x"], []),
    "prop_seq": (["c", "x"], []),
    **{f"prop_{x}": (["x"], []) for x in ("alt", "plus", "star", "opt", "neg")},
    "prop_inv": (["n"], []),
    "shortest_path": (["c"], ["v"]),
    "shortest_path_len": (["c"], ["v"]),
    "khop_filter": (["s"], []),
    **{x: (["a"], ["v"]) for x in ("khop_reachable", "khop_enumerate", "cycle_boolean", "cycle_path", "simple_cycle")},
}.items():
    QUERIES[_name] = QUERIES[_name][0], _texts(QUERIES[_name][1], *_columns)

#: Queries answered through a top-k method.
METHOD = {name: "PTAB" for name in QUERIES if name.startswith("topk_")}
