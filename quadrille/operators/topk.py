"""Top-k subgraph matching: ORDER BY a linear score, LIMIT k.

Sorting all matches is always right. ``pruned`` cuts before the joins, bottom up: a part of
the pattern that shares one variable with the rest can only bring its best k rows for each
value of that variable into a global top k, so it is cut with row_number <= k (Spark turns
that into WindowGroupLimit, which also cuts before the shuffle) and joined to a neighbour.
The two are one part from there on, and are cut again in turn, until one part is left - the
root - or a cycle, whose parts are joined whole. Parts of many rows a value go first, so
the root is one that the others refer to; a part that has one row a value gains nothing
and isn't cut. The score adds up over the parts, and ties break in one order at every level.
Values that are no numbers drop out of a scored match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quadrille.functions import terms as T
from quadrille.plans import syntax as S
from quadrille.plans.relation import Binding, Relation, fresh, join
from quadrille.sources.graph import connected

#: Accepted method names, and whether leaves are pruned. All give the same answer.
METHODS = {"Naive": False} | dict.fromkeys(("PTAB", "DP-B", "DP-P", "DPBany", "kTPM", "DFS-OLD", "Take-all", "Take2", "Eager", "SAE"), True)


@dataclass
class Linear:
    weights: dict[str, float]
    constant: float = 0.0


def linear(e) -> Linear | None:
    """The weights of a linear expression, or None."""
    if isinstance(e, S.Var):
        return Linear({e.name: 1.0})
    if isinstance(e, S.Lit):
        return Linear({}, float(e.lex)) if e.datatype in T.NUMERIC else None
    if not isinstance(e, S.Call):
        return None
    parts = [linear(x) for x in e.args]
    if None in parts:
        return None
    if e.name == "neg":
        return _scaled(parts[0], -1.0)
    if e.name in ("+", "-"):
        other = _scaled(parts[1], 1.0 if e.name == "+" else -1.0)
        names = parts[0].weights | {v: parts[0].weights.get(v, 0.0) + w for v, w in other.weights.items()}
        return Linear(names, parts[0].constant + other.constant)
    if e.name == "*":
        for a, b in (parts, parts[::-1]):
            if not a.weights:
                return _scaled(b, a.constant)
    if e.name == "/" and not parts[1].weights and parts[1].constant:
        return _scaled(parts[0], 1 / parts[1].constant)
    return None


def _scaled(x: Linear, by: float) -> Linear:
    return Linear({v: w * by for v, w in x.weights.items()}, x.constant * by)


def _value(b: Binding) -> Column:
    return T.any_number(F.col(b.col)) if b.kind == "term" else F.col(b.col).cast("double") if b.kind in ("int", "num") else F.lit(None).cast("double")


def pruned(compiler, q: S.Query) -> Relation | None:
    """Matches that hold the top k, with non-numeric scores dropped; None where the query's
    shape doesn't allow it."""
    from quadrille.plans.expressions import evaluate, truth

    tests = [p.expr for p in q.where.parts if isinstance(p, S.Filter)]
    triples = [p for p in q.where.parts if isinstance(p, S.Triple)]
    if len(tests) + len(triples) < len(q.where.parts) or q.limit is None or not q.order_by or q.distinct or q.group_by:
        return None
    if any(isinstance(t.p, S.Path) for t in triples) or not (score := linear(q.order_by[0][0])) or not score.weights:
        return None
    parts = compiler.graph.scans([_plain(t) for t in triples])
    sign = -1.0 if q.order_by[0][1] else 1.0
    k = q.limit + q.offset
    for test in tests:
        names = {x.name for x in _walk(test) if isinstance(x, S.Var)}
        home = next((i for i, r in enumerate(parts) if names <= set(r.vars)), None)
        if home is None or any(isinstance(x, (S.Exists, S.PathCall)) for x in _walk(test)):
            return None
        parts[home] = Relation(parts[home].df.where(truth(evaluate(test, parts[home].vars, {}))), parts[home].vars, parts[home].key)
    for i, r in enumerate(parts):
        df = r.df
        for v in score.weights:
            if v in r.vars:
                df = df.where(_value(r.vars[v]).isNotNull())
        parts[i] = Relation(df, r.vars, r.key)
    if not all(isinstance(e, S.Var) for e, _ in q.order_by[1:]):
        return connected(parts)

    def best(r: Relation, v: str) -> Relation:
        """The best k rows for each value of v."""
        part = sum((_value(r.vars[x]) * (w * sign) for x, w in score.weights.items() if x in r.vars and x != v), F.lit(0.0))
        rest = [F.col(r.vars[e.name].col).desc_nulls_last() if down else F.col(r.vars[e.name].col).asc_nulls_first() for e, down in q.order_by[1:] if e.name in r.vars]
        tie = [F.col(b.col) for x, b in r.vars.items() if x != v]
        rank, partial = fresh(), fresh()
        by = Window.partitionBy(r.vars[v].col).orderBy(partial, *rest, *tie)
        df = r.df.withColumn(partial, part).withColumn(rank, F.row_number().over(by)).where(F.col(rank) <= k)
        return Relation(df.select(*[b.col for b in r.vars.values()]), r.vars)

    while len(parts) > 1:
        hung = []  # parts that share one variable with the rest, those of many rows a value first
        for i, r in enumerate(parts):
            shared = [v for v in r.vars if any(v in x.vars for x in parts if x is not r)]
            if len(shared) == 1:
                hung.append((r.key == shared[0], i, shared[0]))
        if not hung:
            break
        single, i, v = min(hung)
        leaf = parts.pop(i)
        to = min((j for j, x in enumerate(parts) if v in x.vars), key=lambda j: parts[j].key != v)
        joined = join(parts[to], leaf if single else best(leaf, v))
        joined.key = parts[to].key if single else None
        parts[to] = joined
    return connected(parts)


def _plain(t: S.Triple) -> S.Triple:
    from quadrille.plans.compiler import _open

    return _open(t)


def _walk(e):
    yield e
    for x in e.args if isinstance(e, S.Call) else ():
        yield from _walk(x)
