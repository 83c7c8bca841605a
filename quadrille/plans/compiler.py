"""Compiles parsed queries to DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import terms as T
from quadrille.operators import topk as K
from quadrille.operators.paths import closure, path_call
from quadrille.plans import syntax as S
from quadrille.plans.expressions import Value, constant, evaluate, lexical, number, term, truth
from quadrille.plans.relation import Binding, Relation, exists, fresh, join, left_join, minus, promoted, renamed, union
from quadrille.sources.graph import Graph, constant_term


def _walk(e):
    yield e
    for x in e.args if isinstance(e, S.Call) else ():
        yield from _walk(x)


def _all_equal(pairs: list[tuple[str, str]]):
    """Columns equal, or null together."""
    return reduce(lambda x, y: x & y, [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs])


def _variables(e) -> set[str]:
    return {x.name for x in _walk(e) if isinstance(x, S.Var)}


class Compiler:
    def __init__(self, graph: Graph):
        self.graph = graph

    # -- patterns
    def unit(self) -> Relation:
        return Relation(self.graph.spark.range(1).select(), {})

    def group(self, g: S.Group, filters: bool = True) -> Relation | None:
        rel, pending, tests = None, [], []

        def flush():
            nonlocal rel, pending
            if pending:
                got = self.basic(pending)
                rel, pending = got if rel is None else join(rel, got), []

        def meet(got: Relation):
            nonlocal rel
            flush()
            rel = got if rel is None else join(rel, got)

        for part in g.parts:
            if isinstance(part, S.Triple):
                pending.append(_open(part))
            elif isinstance(part, S.Filter):
                tests.append(part.expr)
            elif isinstance(part, S.Optional_):
                flush()
                rel = self.optional(rel or self.unit(), part.group)
            elif isinstance(part, S.Minus):
                flush()
                rel = minus(rel or self.unit(), self.group(part.group))
            elif isinstance(part, S.Union_):
                arms = [self.group(x) for x in part.groups]
                got = arms[0]
                for arm in arms[1:]:
                    got = union(got, renamed(arm))
                meet(got)
            elif isinstance(part, S.Bind):
                flush()
                rel = self.extend(rel or self.unit(), part.var, part.expr)
            elif isinstance(part, S.Values):
                meet(self.values(part))
            elif isinstance(part, S.Query):
                meet(self.query(part)[0])
            else:
                meet(self.group(part))
        flush()
        rel = rel or self.unit()
        if filters:
            for test in tests:
                rel = self.filter(rel, test)
        return rel

    def basic(self, triples: list[S.Triple]) -> Relation:
        """A run of triple patterns: plain ones together, property paths joined to them."""
        plain = [t for t in triples if not isinstance(t.p, S.Path)]
        rel = self.graph.bgp(plain) if plain else None
        for t in triples:
            if isinstance(t.p, S.Path):
                got = self.path(t)
                rel = got if rel is None else join(rel, got)
        return rel

    def optional(self, rel: Relation, g: S.Group) -> Relation:
        tests = [p.expr for p in g.parts if isinstance(p, S.Filter)]
        right = renamed(self.group(g, filters=False))
        hard = [t for t in tests if any(isinstance(x, (S.Exists, S.PathCall)) for x in _walk(t))]
        for t in hard:
            right = self.filter(right, t)
        tests = [t for t in tests if t not in hard]

        def condition(scope):
            out = F.lit(True)
            for t in tests:
                out = out & truth(evaluate(t, scope, {}))
            return out

        return left_join(rel, right, condition if tests else None)

    def filter(self, rel: Relation, test) -> Relation:
        if isinstance(test, S.Call) and test.name == "&&":
            for x in test.args:
                rel = self.filter(rel, x)
            return rel
        if isinstance(test, S.Call) and test.name == "!" and isinstance(test.args[0], S.Exists):
            test = S.Exists(test.args[0].group, not test.args[0].negated)
        if isinstance(test, S.Exists):
            inner = [p.expr for p in test.group.parts if isinstance(p, S.Filter)]
            right = self.group(test.group, filters=False)
            certain = {v for v, b in right.vars.items() if not b.maybe}
            for t in [t for t in inner if _variables(t) <= certain]:  # sees nothing from outside
                right = self.filter(right, t)
                inner.remove(t)

            def condition(scope):
                out = F.lit(True)
                for t in inner:
                    out = out & truth(evaluate(t, scope, {}))
                return out

            return exists(rel, right, test.negated, condition if inner else None)
        rel, special = self.prepared(rel, [test])
        kept = rel.df.where(truth(evaluate(test, rel.vars, special)))
        return Relation(kept.select(*[b.col for b in rel.vars.values()]), rel.vars)

    def prepared(self, rel: Relation, exprs: list) -> tuple[Relation, dict[int, Value]]:
        """Path calls and EXISTS within expressions as columns of the relation."""
        special: dict[int, Value] = {}
        nodes = [x for e in exprs for x in _walk(e)]
        calls = [x for x in nodes if isinstance(x, S.PathCall)]
        rel = promoted(rel, {v.name for x in calls for v in (x.src, x.dst) if isinstance(v, S.Var) and v.name in rel.vars})
        for x in calls:
            rel, special[id(x)] = self.path_value(rel, x)
        for x in nodes:
            if isinstance(x, S.Exists):
                rel, special[id(x)] = self.exists_value(rel, x)
        return rel, special

    def exists_value(self, rel: Relation, x: S.Exists) -> tuple[Relation, Value]:
        """EXISTS as a column: the distinct values of the variables that it sees are
        judged once and joined to the rows."""
        inner = {v for p in x.group.parts if isinstance(p, S.Filter) for v in _variables(p.expr)} | set(self.group(x.group, filters=False).vars)
        seen = {v: b for v, b in rel.vars.items() if v in inner}
        keys = renamed(Relation(rel.df.select(*[b.col for b in seen.values()]).distinct(), seen)) if seen else self.unit()
        flag = fresh()
        kept = self.filter(keys, S.Exists(x.group, False))
        hit = kept.df.select(*[kept.vars[v].col for v in seen], F.lit(True).alias(flag))
        if seen:
            both = rel.df.join(hit, _all_equal([(rel.vars[v].col, kept.vars[v].col) for v in seen]), "left")
            found = F.coalesce(flag, F.lit(False))
        else:
            both, found = rel.df, hit.agg(F.count(flag)).scalar() > 0
        out = fresh()
        df = both.select(*rel.df.columns, (found != F.lit(x.negated)).alias(out))
        return Relation(df, rel.vars), Value(F.col(out), "bool")

    def extend(self, rel: Relation, name: str, expr) -> Relation:
        if name in rel.vars:
            raise S.QueryError(f"?{name} is bound already")
        rel, special = self.prepared(rel, [expr])
        v = evaluate(expr, rel.vars, special)
        b = Binding(fresh(), v.kind, v.template, True)
        return Relation(rel.df.select(*[F.col(x.col) for x in rel.vars.values()], v.col.alias(b.col)), {**rel.vars, name: b})

    def values(self, v: S.Values) -> Relation:
        out, cols = {}, []
        for i, name in enumerate(v.names):
            column = [r[i] for r in v.rows]
            known = [constant(x) for x in column if x is not None]
            one = {(k.kind, k.template) for k in known}
            kind = next(iter(one))[0] if len(one) == 1 else "term"
            out[name] = Binding(fresh(), kind, "", len(known) < len(column))
            cols.append([None if x is None else constant_term(x) if kind == "term" else _native(x, kind) for x in column])
        types = {"int": "bigint", "num": "double", "bool": "boolean", "ts": "timestamp_ntz"}
        schema = ", ".join(f"{b.col} string" if b.kind not in ("int", "num", "bool") else f"{b.col} {types[b.kind]}" for b in out.values())
        df = self.graph.spark.createDataFrame(list(zip(*cols, strict=True)), schema)
        for b in out.values():
            if b.kind == "ts":
                df = df.withColumn(b.col, F.col(b.col).try_cast("timestamp_ntz"))
        return Relation(df, out)

    # -- property paths
    def path(self, t: S.Triple) -> Relation:
        start = constant_term(t.s) if not isinstance(t.s, S.Var) else None
        end = constant_term(t.o) if not isinstance(t.o, S.Var) else None
        df = self.path_pairs(t.p, start, end)
        if start:
            df = df.where(F.col("s") == start)
        if end:
            df = df.where(F.col("o") == end)
        out, cols = {}, []
        if isinstance(t.s, S.Var) and t.s == t.o:
            df = df.where("s = o")
        for x, c in ((t.s, "s"), (t.o, "o")):
            if isinstance(x, S.Var) and x.name not in out:
                out[x.name] = Binding(fresh(), "term")
                cols.append(F.col(c).alias(out[x.name].col))
        return Relation(df.select(*cols), out)

    def path_pairs(self, p: S.Path, start: str | None = None, end: str | None = None) -> DataFrame:
        """s, o of a path. start, end: constants that bound what has to be searched."""
        swap = [F.col("o").alias("s"), F.col("s").alias("o")]
        if p.kind == "link":
            return self.graph.pairs(p.parts[0])
        if p.kind == "inv":
            return self.path_pairs(p.parts[0], end, start).select(*swap)
        if p.kind == "seq":
            df = self.path_pairs(p.parts[0], start)
            for part in p.parts[1:]:
                right = self.path_pairs(part).select(F.col("s").alias("m"), F.col("o").alias("o2"))
                df = df.join(right, F.col("o") == F.col("m")).select("s", F.col("o2").alias("o"))
            return df
        if p.kind == "alt":
            df = self.path_pairs(p.parts[0], start, end)
            for part in p.parts[1:]:
                df = df.unionAll(self.path_pairs(part, start, end))
            return df
        if p.kind == "neg":
            forward, back = p.parts
            t = self.graph.triples()
            ahead = t.where(~F.col("p").isin([f"<{x}>" for x in forward])).select("s", "o")
            behind = t.where(~F.col("p").isin([f"<{x}>" for x in back])).select(*swap)
            return ahead if not back else behind if not forward else ahead.unionAll(behind)
        inner = self.path_pairs(p.parts[0]).distinct()
        spark = self.graph.spark
        if p.kind in ("opt", "star"):
            one = start or end
            nodes = spark.createDataFrame([(one,)], "n string") if one else self.graph.nodes()
            same = nodes.select(F.col("n").alias("s"), F.col("n").alias("o"))
        if p.kind == "opt":
            return inner.unionAll(same).distinct()
        if start is None and end is not None:  # search backwards from the one end
            found = closure(inner.select(*swap), spark.createDataFrame([(end,)], "n string")).select(*swap)
        else:
            found = closure(inner, spark.createDataFrame([(start,)], "n string") if start else None)
        return found if p.kind == "plus" else found.unionAll(same).distinct()

    # -- path calls
    def path_value(self, rel: Relation, call: S.PathCall) -> tuple[Relation, Value]:
        """The call's value for each row; its variables are terms already."""

        def end(x):
            if isinstance(x, S.Var):
                return F.col(rel.vars[x.name].col) if x.name in rel.vars else F.lit(None).cast("string")
            return F.lit(constant_term(x))

        pairs = rel.df.select(end(call.src).alias("src"), end(call.dst).alias("dst")).distinct()
        found, kind = path_call(call.name, pairs, self.graph.edges(call.predicates), call.directed, call.k)
        a, b, v = fresh(), fresh(), fresh()
        found = found.select(F.col("src").alias(a), F.col("dst").alias(b), F.col("value").alias(v))
        df = rel.df.join(found, (end(call.src) == F.col(a)) & (end(call.dst) == F.col(b)), "left").drop(a, b)
        if kind == "bool":
            df = df.withColumn(v, F.coalesce(v, F.lit(False)))
        return Relation(df, rel.vars), Value(F.col(v), kind)

    # -- solution modifiers
    def query(self, q: S.Query, method: str | None = None) -> tuple[Relation, list[str]]:
        """The projected relation and the order of its variables."""
        rel = K.pruned(self, q) if method and K.METHODS[method] else None
        rel = rel or self.group(q.where)
        visible = [v for v in rel.vars if not v.startswith("__")]
        items = q.items if q.items is not None else [(v, None) for v in visible]
        orders = [e for e, _ in q.order_by]
        exprs = [e for _, e in items if e is not None]
        special: dict[int, Value] = {}
        aggregates = [x for e in [*exprs, *q.having, *orders] for x in _walk(e) if isinstance(x, S.Call) and x.name in S.AGGREGATES]
        if q.group_by or aggregates:
            if q.items is None:
                raise S.QueryError("SELECT * can't be grouped")
            keys = {name for name, _ in q.group_by}
            if bad := [n for n, e in items if e is None and n not in keys]:
                raise S.QueryError(f"?{bad[0]} is neither grouped nor aggregated")
            rel, special = self.grouped(rel, q, aggregates)
            for test in q.having:
                rel = Relation(rel.df.where(truth(evaluate(test, rel.vars, special))), rel.vars)
        rel, more = self.prepared(rel, [*exprs, *orders])
        special |= more
        made, cols = dict(rel.vars), []
        for name, e in items:
            if e is not None:
                v = evaluate(e, made, special)
                made[name] = Binding(fresh(), v.kind, v.template, True)
                rel = Relation(rel.df.withColumn(made[name].col, v.col), made)
            elif name not in made:
                made[name] = Binding(fresh(), "term", "", True)
                rel = Relation(rel.df.withColumn(made[name].col, F.lit(None).cast("string")), made)
        names = [n for n, _ in items]
        cols = [made[n].col for n in names]
        by = []
        for e, down in q.order_by:
            by += [c.desc_nulls_last() if down else c.asc_nulls_first() for c in _sort_keys(evaluate(e, made, special))]
        df = rel.df
        if q.distinct:
            df = df.select(*cols).distinct()
        if by:
            df = df.orderBy(*by)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Relation(df.select(*cols), {n: made[n] for n in names}), names

    def grouped(self, rel: Relation, q: S.Query, aggregates: list[S.Call]) -> tuple[Relation, dict[int, Value]]:
        keys, out = [], {}
        for name, e in q.group_by:
            v = evaluate(e if e is not None else S.Var(name), rel.vars, {})
            out[name] = Binding(fresh(), v.kind, v.template, True)
            keys.append(v.col.alias(out[name].col))
        special, made = {}, []
        for a in aggregates:
            v = evaluate(a.args[0], rel.vars, {}) if a.args else None
            name = fresh()
            col, kind, template = _aggregate(a, v, rel)
            made.append(col.alias(name))
            special[id(a)] = Value(F.col(name), kind, template)
        if not made:
            made.append(F.count(F.lit(1)).alias(fresh()))
        return Relation(rel.df.groupBy(*keys).agg(*made), out), special


def _aggregate(a: S.Call, v: Value | None, rel: Relation):
    if a.name == "count":
        if v is None:
            return (F.count_distinct(F.struct(*[b.col for b in rel.vars.values()])) if a.distinct else F.count(F.lit(1))), "int", ""
        return (F.count_distinct if a.distinct else F.count)(v.col), "int", ""
    if a.name in ("sum", "avg"):
        n = number(v)
        total = {("sum", False): F.sum, ("sum", True): F.sum_distinct, ("avg", False): F.avg}.get((a.name, a.distinct))
        if v.kind == "term" and a.name == "sum":
            whole = F.bool_and(F.when(number(v).isNotNull(), T.datatype(v.col).isin(T.WHOLE)))
            value = total(n)
            text = F.when(whole, T.literal(value.cast("bigint").cast("string"), T.XSD + "integer")).otherwise(T.literal(value.cast("string"), T.XSD + "double"))
            return F.when(value.isNotNull(), text), "term", ""
        if total is None:
            return F.try_divide(F.sum_distinct(n).cast("double"), F.count_distinct(n).cast("double")), "num", ""
        return (total(n).cast("bigint") if v.kind == "int" and a.name == "sum" else total(n).cast("double")), "int" if v.kind == "int" and a.name == "sum" else "num", ""
    if a.name in ("min", "max"):
        f = F.min if a.name == "min" else F.max
        if v.kind == "term":  # in the order of ORDER BY; the term itself comes back
            return f(F.when(v.col.isNotNull(), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(_sort_keys(v))]))).getField("k4"), "term", ""
        return f(v.col), v.kind, v.template
    if a.name == "sample":
        return F.min(v.col), v.kind, v.template
    text = lexical(v)
    parts = F.array_sort(F.collect_set(text) if a.distinct else F.collect_list(text))
    return F.array_join(parts, a.separator), "str", ""


def _sort_keys(v: Value):
    """Unbound, then blank nodes, IRIs, literals; numbers by value."""
    if v.kind == "iri":
        return [lexical(v)]
    if v.kind != "term":
        return [v.col]
    c = v.col
    rank = F.when(c.isNull(), 0).when(T.is_blank(c), 1).when(T.is_iri(c), 2).otherwise(3)
    return [rank, T.number(c), T.timestamp(c), lexical(v), c]


def _native(x, kind: str):
    if kind == "iri":
        return x.text
    return {"int": int, "num": float, "bool": lambda s: s in ("true", "1")}.get(kind, str)(x.lex)


def _open(t: S.Triple) -> S.Triple:
    """Blank nodes of a pattern are variables that can't be selected."""

    def var(x):
        return S.Var("__b" + x.label) if isinstance(x, S.Blank) else x

    return S.Triple(var(t.s), t.p, var(t.o))


def output(rel: Relation, names: list[str], terms: bool = False) -> DataFrame:
    """Columns by variable name: native values, IRI texts and lexical forms, or canonical
    terms."""
    cols = []
    for n in names:
        v = Value(F.col(rel.vars[n].col), rel.vars[n].kind, rel.vars[n].template)
        plain = F.coalesce(lexical(v), v.col) if v.kind == "term" else lexical(v) if v.kind == "iri" else v.col
        cols.append((term(v) if terms else plain).alias(n))
    return rel.df.select(*cols)


def instantiate(rel: Relation, template: list[S.Triple]) -> DataFrame:
    """s, p, o of a template over the solutions; a row with an unbound variable gives none.
    A blank node is new in each solution."""
    rel = promoted(rel, rel.vars)
    key = F.md5(F.concat_ws("|", *[F.coalesce(F.col(b.col), F.lit("")) for b in rel.vars.values()])) if rel.vars else F.lit("")

    def col(x):
        if isinstance(x, S.Var):
            return F.col(rel.vars[x.name].col) if x.name in rel.vars else F.lit(None).cast("string")
        return F.concat(F.lit(f"_:{x.label}x"), key) if isinstance(x, S.Blank) else F.lit(constant_term(x))

    rows = F.array(*[F.struct(col(t.s).alias("s"), col(t.p).alias("p"), col(t.o).alias("o")) for t in template])
    return rel.df.select(F.explode(rows).alias("t")).select("t.*").where("s is not null and p is not null and o is not null").distinct()


def describe(compiler: Compiler, q: S.Query) -> DataFrame:
    graph = compiler.graph
    parts = [graph.matching(**{end: x}) for x in q.targets if not isinstance(x, S.Var) for end in "so"]
    names = [x.name for x in q.targets if isinstance(x, S.Var)]
    if names:
        rel, t = promoted(compiler.group(q.where), names), graph.triples()
        nodes = reduce(DataFrame.unionAll, [rel.df.select(F.col(rel.vars[n].col).alias("n")) for n in names]).distinct()
        parts += [t.join(nodes, t[end] == nodes.n, "left_semi") for end in "so"]
    return reduce(DataFrame.unionAll, parts).distinct()


def run(graph: Graph, text: str, prefixes: dict[str, str] | None = None, terms: bool = False, method: str | None = None) -> DataFrame:
    """Results of a query. ``method`` names how ORDER BY with LIMIT is answered."""
    if method is not None and method not in K.METHODS:
        raise S.QueryError(f"unknown method {method}")
    q = S.parse_query(text, prefixes)
    compiler = Compiler(graph)
    if q.form == "ask":
        rel = compiler.group(q.where)
        return rel.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("_askResult"))
    if q.form == "construct":
        return instantiate(compiler.group(q.where), q.template)
    if q.form == "describe":
        return describe(compiler, q)
    rel, names = compiler.query(q, method)
    return output(rel, names, terms)
