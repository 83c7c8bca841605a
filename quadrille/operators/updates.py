"""Updates: a new graph in place of a changed one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.plans import syntax as S
from quadrille.plans.compiler import Compiler, instantiate
from quadrille.plans.relation import Relation
from quadrille.sources.graph import TripleGraph


def changes(graph: TripleGraph, text: str, prefixes: dict[str, str] | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """Triples to delete and to insert (s, p, o); None for neither."""
    u = S.parse_update(text, prefixes)
    compiler = Compiler(graph)
    rel = compiler.group(u.where) if u.where is not None else Relation(compiler.unit().df, {})
    return tuple(instantiate(rel, t) if t else None for t in (u.delete, u.insert))


def changed(graph: TripleGraph, text: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """deleted, inserted: the triples that an update takes away and those that it adds to
    what is left, in one row."""
    gone, new = changes(graph, text, prefixes)
    parts = []
    if gone is not None:
        parts.append(graph.held(gone.distinct()).select(F.lit(1).alias("deleted"), F.lit(0).alias("inserted")))
        graph = graph.remove(gone)
    if new is not None:
        parts.append(graph.missing(new).select(F.lit(0).alias("deleted"), F.lit(1).alias("inserted")))
    return reduce(DataFrame.unionAll, parts).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("deleted", "inserted")])


def update(graph: TripleGraph, text: str, prefixes: dict[str, str] | None = None) -> TripleGraph:
    """The graph after an update: deletions first, then insertions, both of the same solutions."""
    gone, new = changes(graph, text, prefixes)
    if gone is not None:
        graph = graph.remove(gone)
    return graph.insert(new) if new is not None else graph
