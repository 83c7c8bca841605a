"""Solution sequences as DataFrames: each variable a column with static type knowledge."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import terms as T

_ids = itertools.count()


def fresh() -> str:
    return f"c{next(_ids)}"


@dataclass(frozen=True)
class Binding:
    """col: column name. kind: term (canonical strings), iri (``template`` and a native key),
    int, num, str, ts, bool. maybe: can be unbound (null)."""

    col: str
    kind: str
    template: str = ""
    maybe: bool = False


@dataclass
class Relation:
    """key: the variable whose value fixes a row, if there is one."""

    df: DataFrame
    vars: dict[str, Binding]
    key: str | None = None


def term_column(col: Column, kind: str, template: str = "") -> Column:
    """Canonical term of a native value."""
    if kind == "term":
        return col
    if kind == "iri":
        return F.concat(F.lit("<" + template), col.cast("string"), F.lit(">"))
    if kind == "str":
        return T.literal(col)
    if kind == "ts":
        return T.literal(F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss"), T.XSD + "dateTime")
    return T.literal(col.cast("string"), T.XSD + {"int": "integer", "num": "double", "bool": "boolean"}[kind])


def renamed(rel: Relation) -> Relation:
    """The same solutions under new column names, so that a frame can meet itself."""
    new = {v: replace(b, col=fresh()) for v, b in rel.vars.items()}
    return Relation(rel.df.select(*[F.col(b.col).alias(new[v].col) for v, b in rel.vars.items()]), new)


def promoted(rel: Relation, names) -> Relation:
    """The named variables as canonical terms."""
    names = [n for n in names if rel.vars[n].kind != "term"]
    if not names:
        return rel
    out, cols = dict(rel.vars), []
    for v, b in rel.vars.items():
        if v in names:
            out[v] = Binding(fresh(), "term", "", b.maybe)
            cols.append(term_column(F.col(b.col), b.kind, b.template).alias(out[v].col))
        else:
            cols.append(F.col(b.col))
    return Relation(rel.df.select(*cols), out)


def aligned(a: Relation, b: Relation, names) -> tuple[Relation, Relation]:
    odd = [v for v in names if (a.vars[v].kind, a.vars[v].template) != (b.vars[v].kind, b.vars[v].template)]
    return promoted(a, odd), promoted(b, odd)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions) if conditions else F.lit(True)


def _meets(a: Binding, b: Binding) -> Column:
    """Equal, or unbound on a side that can be."""
    same = F.col(a.col) == F.col(b.col)
    if a.maybe:
        same = same | F.col(a.col).isNull()
    if b.maybe:
        same = same | F.col(b.col).isNull()
    return same


def _picked(df: DataFrame, a: Relation, b: Relation, outer: bool) -> Relation:
    cols, out = [], {}
    for v, x in a.vars.items():
        y = b.vars.get(v)
        if y and x.maybe:
            out[v] = Binding(fresh(), x.kind, x.template, x.maybe and (y.maybe or outer))
            cols.append(F.coalesce(x.col, y.col).alias(out[v].col))
        else:
            out[v] = x
            cols.append(F.col(x.col))
    for v, y in b.vars.items():
        if v not in a.vars:
            out[v] = replace(y, maybe=y.maybe or outer)
            cols.append(F.col(y.col))
    return Relation(df.select(*cols), out)


def _loose(a: Relation, b: Relation) -> list[str]:
    """Shared variables that can be unbound, if no shared variable is always bound: then
    rows are told apart by what they bind. An equi-join on one certain key does without."""
    shared = [v for v in a.vars if v in b.vars]
    loose = [v for v in shared if a.vars[v].maybe or b.vars[v].maybe]
    return loose if len(loose) == len(shared) else []


def _by_bound(rel: Relation, names: list[str]) -> list[tuple[set[str], Relation]]:
    """The relation's rows by which of the named variables they bind."""
    maybe = [v for v in names if rel.vars[v].maybe]
    out = []
    for bound in itertools.product((True, False), repeat=len(maybe)):
        test = _all([F.col(rel.vars[v].col).isNotNull() if is_ else F.col(rel.vars[v].col).isNull() for v, is_ in zip(maybe, bound, strict=True)])
        own = {v for v, is_ in zip(maybe, bound, strict=True) if is_} | {v for v in names if v not in maybe}
        out.append((own, Relation(rel.df.where(test) if maybe else rel.df, rel.vars)))
    return out


def _is_empty(df: DataFrame) -> Column:
    """Whether a frame has no rows, as a scalar subquery."""
    return df.limit(1).agg(F.count(F.lit(1))).scalar() == 0


def _equal(a: Relation, b: Relation, names) -> Column:
    return _all([F.col(a.vars[v].col) == F.col(b.vars[v].col) for v in sorted(names)])


def _matched(a: Relation, b: Relation, common: set[str], kind: str, condition: Column | None) -> DataFrame:
    """Rows of ``a`` that have (left_semi) or lack (left_anti) a partner with equal values
    of ``common``."""
    if common:
        on = _equal(a, b, common)
        return a.df.join(b.df, on if condition is None else on & condition, kind)
    if condition is None:
        empty = _is_empty(b.df)
        return a.df.where(empty if kind == "left_anti" else ~empty)
    return a.df.join(b.df, condition, kind)


def _lacking(a: Relation, parts: list[tuple[set[str], Relation]], own: set[str], condition: Column | None, products: bool) -> Relation:
    """Rows of ``a``, which bind ``own``, without a partner in any of the parts. products:
    rows with no variable in common are partners."""
    for bound, b in parts:
        if own & bound or products:
            a = Relation(_matched(a, b, own & bound, "left_anti", condition), a.vars)
    return a


def _joined(a: Relation, b: Relation, common: set[str], condition: Column | None) -> Relation:
    # few rows of a bind nothing in common, if any: a product whose tasks are pairs of partitions. Its
    # left side is the outer loop: those few are what is held, and their terms repeat at short distances,
    # so that files of the product compress to little
    df = a.df.join(b.df, _equal(a, b, common)) if common else b.df.hint("shuffle_replicate_nl").crossJoin(a.df)
    return _picked(df if condition is None else df.where(condition), a, b, False)


# Of the files under a relation: bytes that are dealt to a task, and those up to which that is done.
_DEALT, _DEALT_UP_TO = 16 << 10, 10 << 20


def _file_bytes(df: DataFrame) -> int:
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def _dealt(a: Relation, b: Relation, either: bool = True) -> tuple[DataFrame, DataFrame]:
    """Frames of a join in which a row meets many. Small tables come in one partition and few
    values of a key in few, whose tasks would grow with the square of the tables: one side
    is dealt to as many tasks as its size asks for and each of them sees the other whole.
    either: whether it can be ``b``. Large tables with so many partners have no end anyway."""
    if "term" in {rel.vars[v].kind for rel in (a, b) for v in rel.vars}:  # triples in files of their own
        return a.df, b.df
    x, y = _file_bytes(a.df), _file_bytes(b.df)
    if max(x, y) > _DEALT_UP_TO:
        return a.df, b.df
    if y > x and either:
        return F.broadcast(a.df), b.df.repartition(-(-y // _DEALT))
    return a.df.repartition(-(-x // _DEALT)) if x else a.df, F.broadcast(b.df)


def _many(a: Relation, b: Relation, shared: list[str]) -> bool:
    """Whether a row of either side can meet many of the other."""
    return a.key not in shared and b.key not in shared


def join(a: Relation, b: Relation) -> Relation:
    shared = [v for v in a.vars if v in b.vars]
    many, key = _many(a, b, shared), a.key if b.key in shared else b.key if a.key in shared else None
    key = None if any(r.vars[v].maybe for r in (a, b) for v in shared) else key
    a, b = aligned(a, b, shared)
    if not shared:
        return _picked(a.df.crossJoin(b.df), a, b, False)
    if loose := _loose(a, b):
        return reduce(union, [renamed(_joined(x, y, own & other, None)) for own, x in _by_bound(a, loose) for other, y in _by_bound(b, loose)])
    left, right = _dealt(a, b) if many else (a.df, b.df)
    both = _picked(left.join(right, _all([_meets(a.vars[v], b.vars[v]) for v in shared])), a, b, False)
    both.key = key
    return both


def left_join(a: Relation, b: Relation, condition) -> Relation:
    """OPTIONAL; condition(relation of both sides) is the filter within, or None."""
    shared = [v for v in a.vars if v in b.vars]
    many = _many(a, b, shared)
    a, b = aligned(a, b, shared)
    test = condition({**b.vars, **a.vars}) if condition is not None else None
    if loose := _loose(a, b):
        out, parts = [], _by_bound(b, loose)
        for own, x in _by_bound(a, loose):
            out += [_joined(x, y, own & other, test) for other, y in parts]
            out.append(_lacking(x, parts, own, test, True))
        return reduce(union, map(renamed, out))
    on = [_meets(a.vars[v], b.vars[v]) for v in shared] + ([test] if test is not None else [])
    left, right = _dealt(a, b, either=False) if many and shared else (a.df, b.df)
    return _picked(left.join(right, _all(on), "left"), a, b, True)


def union(a: Relation, b: Relation) -> Relation:
    a, b = aligned(a, b, [v for v in a.vars if v in b.vars])
    out, left, right = {}, [], []
    for v in [*a.vars, *(v for v in b.vars if v not in a.vars)]:
        x, y = a.vars.get(v), b.vars.get(v)
        name = fresh()
        one = x or y
        out[v] = Binding(name, one.kind, one.template, not (x and y) or x.maybe or y.maybe)
        kind = (a if x else b).df.schema[one.col].dataType
        left.append((F.col(x.col) if x else F.lit(None).cast(kind)).alias(name))
        right.append((F.col(y.col) if y else F.lit(None).cast(kind)).alias(name))
    return Relation(a.df.select(*left).unionAll(b.df.select(*right)), out)


def minus(a: Relation, b: Relation) -> Relation:
    shared = [v for v in a.vars if v in b.vars]
    if not shared:
        return a
    b = renamed(b)
    a, b = aligned(a, b, shared)
    if loose := _loose(a, b):
        parts = _by_bound(b, loose)
        return reduce(union, [renamed(_lacking(x, parts, own, None, False)) for own, x in _by_bound(a, loose)])
    on = [_meets(a.vars[v], b.vars[v]) for v in shared]
    return Relation(a.df.join(b.df, _all(on), "left_anti"), a.vars)


def exists(a: Relation, b: Relation, negated: bool, condition=None) -> Relation:
    shared = [v for v in a.vars if v in b.vars]
    b = renamed(b)
    a, b = aligned(a, b, shared)
    test = condition({**b.vars, **a.vars}) if condition is not None else None
    loose = _loose(a, b)
    if not loose and shared:
        on = [_meets(a.vars[v], b.vars[v]) for v in shared] + ([test] if test is not None else [])
        return Relation(a.df.join(b.df, _all(on), "left_anti" if negated else "left_semi"), a.vars)
    out, parts = [], _by_bound(b, loose)
    for own, x in _by_bound(a, loose):
        if negated:
            out.append(_lacking(x, parts, own, test, True))
            continue
        for i, (other, y) in enumerate(parts):  # partners in this part and none before
            rest = _lacking(x, parts[:i], own, test, True)
            out.append(Relation(_matched(rest, y, own & other, "left_semi", test), a.vars))
    return reduce(union, map(renamed, out)) if len(out) > 1 else out[0]
