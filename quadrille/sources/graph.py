"""Graphs that queries run on."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions import terms as T
from quadrille.plans.relation import Binding, Relation, fresh, join, promoted, union
from quadrille.plans.syntax import Iri, Lit, QueryError, Triple, Var


def constant_term(x) -> str:
    """Canonical string of a constant."""
    if isinstance(x, Iri):
        return f"<{x.text}>"
    if isinstance(x, Lit):
        lex = x.lex
        for raw, esc in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            lex = lex.replace(raw, esc)
        tail = f"@{x.lang}" if x.lang else f"^^<{x.datatype}>" if x.datatype and x.datatype != T.XSD + "string" else ""
        return f'"{lex}"{tail}'
    return f"_:{x.label}"


def connected(parts: list[Relation]) -> Relation:
    """Joins parts along shared variables. A part whose key is bound by then adds no rows
    and comes first; the start is a part that no other refers to by key. Components without
    a common variable meet in a product once each is whole."""
    parts, done = list(parts), []

    def next_to(names: set[str]) -> int | None:
        shared = [i for i, p in enumerate(parts) if names & set(p.vars)]
        return next((i for i in shared if parts[i].key in names), shared[0] if shared else None)

    while parts:
        root = next((i for i, p in enumerate(parts) if not any(p.key in q.vars for q in parts if q is not p)), 0)
        at = parts.pop(root)
        while (k := next_to(set(at.vars))) is not None:
            at = join(at, parts.pop(k))
        done.append(at)
    return reduce(join, done)


class Graph:
    spark: SparkSession

    def scans(self, triples: list[Triple]) -> list[Relation]:
        """One relation for each unit of scanning; joining them gives the pattern's solutions."""
        raise NotImplementedError

    def triples(self) -> DataFrame:
        """s, p, o as canonical terms."""
        raise NotImplementedError

    def bgp(self, triples: list[Triple]) -> Relation:
        return connected(self.scans(triples))

    def pairs(self, predicate: str) -> DataFrame:
        """s, o of one predicate as canonical terms."""
        rel = promoted(self.bgp([Triple(Var("s"), Iri(predicate), Var("o"))]), ["s", "o"])
        return rel.df.select(F.col(rel.vars["s"].col).alias("s"), F.col(rel.vars["o"].col).alias("o"))

    def matching(self, s=None, o=None) -> DataFrame:
        """s, p, o of the triples with a constant subject or object, as canonical terms."""
        ends = {"s": s or Var("s"), "p": Var("p"), "o": o or Var("o")}
        rel = self.bgp([Triple(*ends.values())])
        rel = promoted(rel, rel.vars)
        return rel.df.select(*[(F.col(rel.vars[n].col) if isinstance(x, Var) else F.lit(constant_term(x))).alias(n) for n, x in ends.items()])

    def links(self) -> DataFrame:
        """s, p, o of all triples whose object is a node."""
        return self.triples().where(~T.is_literal(F.col("o")))

    def edges(self, predicates: list[str]) -> DataFrame:
        """s, p, o whose object is a node; of all predicates where none is named. A row of
        tables can repeat one."""
        if not predicates:
            return self.links()
        parts = [self.pairs(p).select("s", F.lit(f"<{p}>").alias("p"), "o") for p in predicates]
        return reduce(DataFrame.unionAll, parts).where(~T.is_literal(F.col("o")))

    def nodes(self, literals: bool = True) -> DataFrame:
        """n: every subject and object; without ``literals`` those that can be subjects."""
        t = self.triples()
        found = t.select(F.col("s").alias("n")).union(t.select("o")).distinct()
        return found if literals else found.where(~T.is_literal(F.col("n")))

    def predicates(self) -> DataFrame:
        """p: every predicate."""
        return self.triples().select("p").distinct()

    def predicate_stats(self) -> DataFrame:
        return self.triples().groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s").alias("subjects"), F.countDistinct("o").alias("objects"))

    def type_counts(self) -> DataFrame:
        return self.triples().where(F.col("p") == f"<{T.RDF_TYPE}>").groupBy(F.col("o").alias("type")).agg(F.count(F.lit(1)).alias("n"))


class TripleGraph(Graph):
    """A set of triples in a frame of three term columns. Stored partitioned by p, a bound
    predicate prunes to its folder. links: those whose object is a node, where they can be
    had without the others."""

    def __init__(self, df: DataFrame, links: DataFrame | None = None):
        self.df, self.spark, self._links = df.select("s", "p", "o"), df.sparkSession, links

    @classmethod
    def of(cls, df: DataFrame) -> TripleGraph:
        """Sets triples apart from their repetitions."""
        return cls(df.select("s", "p", "o").dropDuplicates())

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TripleGraph:
        return cls(spark.read.parquet(path))

    def save(self, path: str, mode: str = "error") -> None:
        self.df.write.mode(mode).partitionBy("p").parquet(path)

    def triples(self) -> DataFrame:
        return self.df

    def links(self) -> DataFrame:
        return super().links() if self._links is None else self._links

    def scans(self, triples):
        return sorted((self._scan(t) for t in triples), key=lambda r: len(r.vars))

    def _scan(self, t: Triple) -> Relation:
        df, seen, cols = self.df, {}, []
        for name, x in (("s", t.s), ("p", t.p), ("o", t.o)):
            if not isinstance(x, Var):
                df = df.where(F.col(name) == constant_term(x))
            elif x.name in seen:
                df = df.where(F.col(name) == F.col(seen[x.name][0]))
            else:
                seen[x.name] = name, Binding(fresh(), "term")
                cols.append(F.col(name).alias(seen[x.name][1].col))
        return Relation(df.select(*cols) if cols else df.select(), {v: b for v, (_, b) in seen.items()})

    def held(self, df: DataFrame) -> DataFrame:
        """Which of the triples ``df`` (distinct) the graph holds. The graph is only read:
        the side of ``df`` is hashed or shuffled."""
        return self.df.join(df.select("s", "p", "o"), ["s", "p", "o"], "left_semi")

    def missing(self, df: DataFrame) -> DataFrame:
        """Which of the triples the graph doesn't hold, each once."""
        new = df.select("s", "p", "o").distinct()
        return new.join(self.held(new), ["s", "p", "o"], "left_anti")

    def insert(self, df: DataFrame) -> TripleGraph:
        return TripleGraph(self.df.unionByName(self.missing(df)))

    def remove(self, df: DataFrame) -> TripleGraph:
        return TripleGraph(self.df.join(df.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti"))

    def cache(self) -> TripleGraph:
        """Kept in memory, as far as it fits, until ``unload``."""
        self.df.persist()
        return self

    def unload(self) -> None:
        self.df.unpersist()


class Table:
    """A relation whose rows are subjects. read: gives the frame, when a pattern needs it.
    key: SQL expression (None: a hash of the whole row). columns: predicate -> column or
    (column, template of the node it refers to)."""

    def __init__(self, read: Callable[[], DataFrame], cls: str, template: str, key: str | None, columns: dict):
        self.read, self.cls, self.template, self.columns, self._key = read, cls, template, columns, key

    @cached_property
    def df(self) -> DataFrame:
        return self.read()

    @cached_property
    def types(self) -> dict[str, str]:
        return dict(self.df.dtypes)

    @property
    def unique(self) -> bool:
        """Whether a subject is one row."""
        return self._key is not None

    @property
    def key(self) -> Column:
        return F.expr(self._key) if self._key else F.xxhash64(*self.df.columns)

    def object(self, predicate: str) -> tuple[Column, str, str]:
        """Column, kind and template of a predicate's object."""
        c = self.columns[predicate]
        if isinstance(c, tuple):
            return F.col(c[0]), "iri", c[1]
        kind = self.types.get(c) or self.df.select(F.expr(c)).dtypes[0][1]
        return F.expr(c), {"string": "str", "double": "num", "float": "num", "boolean": "bool", "date": "ts"}.get(kind, "ts" if kind.startswith("timestamp") else "num" if kind.startswith("decimal") else "int"), ""


class MappedGraph(Graph):
    """Relational tables seen as triples. All patterns on one subject over one table are one
    scan, keys stay native, and IRIs are only built where results need them."""

    def __init__(self, spark: SparkSession, tables: list[Table]):
        self.spark, self.tables = spark, tables

    def of_classes(self, *classes: str) -> MappedGraph:
        """The part of the graph that some tables make."""
        return MappedGraph(self.spark, [t for t in self.tables if t.cls in classes])

    def triples(self) -> DataFrame:
        rel = promoted(self.bgp([Triple(Var("s"), Var("p"), Var("o"))]), ["s", "p", "o"])
        return rel.df.select(*[F.col(rel.vars[x].col).alias(x) for x in "spo"])

    def links(self) -> DataFrame:
        from quadrille.plans.relation import term_column

        parts = []
        for tab in self.tables:
            ways = [w for w in self._candidates(tab, Var("o")) if w[2] == "iri"]
            pairs = [F.struct(F.lit(f"<{p}>").alias("p"), (term_column(F.col(source), kind, template) if source else F.lit(f"<{tab.cls}>")).alias("o")) for p, source, kind, template in ways]
            parts.append(tab.df.select(term_column(tab.key, "iri", tab.template).alias("s"), F.explode(F.array(*pairs)).alias("e")).select("s", "e.p", "e.o").where("o is not null"))
        return reduce(DataFrame.unionAll, parts)

    def scans(self, triples):
        stars: dict = {}
        for t in triples:
            stars.setdefault(t.s, []).append(t)
        out = []
        for subject, star in stars.items():
            groups: dict[tuple, list[Triple]] = {}
            allowed = self._referred(subject, triples)
            for t in star:
                groups.setdefault(tuple(i for i, tab in enumerate(self.tables) if self._has(tab, t) and (allowed is None or tab.template in allowed)), []).append(t)
            common = set.intersection(*map(set, groups))
            if common or not all(groups):
                groups = {tuple(sorted(common)): star}
            for where, part in groups.items():
                found = [r for i in where if (r := self._star(self.tables[i], subject, part)) is not None]
                out.append(reduce(union, found) if found else self._nothing(part))
        out.sort(key=lambda r: len(r.vars))
        return out

    def _referred(self, subject, triples: list[Triple]) -> set[str] | None:
        """Templates that a subject can have, being the object of other patterns as well."""
        allowed = None
        for t in triples:
            if t.o == subject and isinstance(subject, Var) and isinstance(t.p, Iri) and t.p.text != T.RDF_TYPE:
                columns = [tab.columns[t.p.text] for tab in self.tables if t.p.text in tab.columns]
                own = {c[1] for c in columns if isinstance(c, tuple)}
                allowed = own if allowed is None else allowed & own
        return allowed

    @staticmethod
    def _has(tab: Table, t: Triple) -> bool:
        if isinstance(t.s, Iri) and not t.s.text.startswith(tab.template):
            return False
        if isinstance(t.p, Var):
            return True
        if t.p.text == T.RDF_TYPE:
            return isinstance(t.o, Var) or t.o == Iri(tab.cls)
        return t.p.text in tab.columns

    def _nothing(self, star: list[Triple]) -> Relation:
        names = dict.fromkeys(x.name for t in star for x in (t.s, t.p, t.o) if isinstance(x, Var))
        cols = {v: Binding(fresh(), "term") for v in names}
        return Relation(self.spark.range(0).select(*[F.lit(None).cast("string").alias(b.col) for b in cols.values()]), cols)

    def _star(self, tab: Table, subject, star: list[Triple]) -> Relation | None:
        df, found, where = tab.df, {}, []

        def bind(name: str, col: Column, kind: str, template: str = "") -> bool:
            if name in found:
                old, k, tpl = found[name]
                if (k, tpl) != (kind, template):
                    return False
                where.append(old == col)
            else:
                found[name] = col, kind, template
            return True

        if isinstance(subject, Var):
            bind(subject.name, tab.key, "iri", tab.template)
        elif isinstance(subject, Iri):
            where.append(tab.key.cast("string") == subject.text[len(tab.template) :])
        else:
            return None
        loose = []
        for t in star:
            if isinstance(t.p, Var):
                loose.append((t, self._candidates(tab, t.o)))
                if not loose[-1][1]:
                    return None
            elif t.p.text == T.RDF_TYPE:
                if isinstance(t.o, Var) and not bind(t.o.name, F.lit(tab.cls), "iri"):
                    return None
            else:
                col, kind, template = tab.object(t.p.text)
                if isinstance(t.o, Var):
                    if not bind(t.o.name, col, kind, template):
                        return None
                    where.append(col.isNotNull())
                elif (test := self._equals(col, kind, template, t.o)) is None:
                    return None
                else:
                    where.append(test)
        for w in where:
            df = df.where(w)
        names = {v: Binding(fresh(), kind, template) for v, (_, kind, template) in found.items()}
        key = fresh()
        row = dict.fromkeys(source for _, ways in loose for _, source, _, _ in ways if source)
        rel = Relation(df.select(*[c.alias(names[v].col) for v, (c, _, _) in found.items()], *([F.struct(F.lit(True).alias("row"), *row).alias(key)] if loose else [])), names)
        for t, ways in loose:
            rel = self._any_predicate(tab, rel, key, t, ways)
        if loose:
            return Relation(rel.df.select(*[b.col for b in rel.vars.values()]), rel.vars)
        rel.key = subject.name if isinstance(subject, Var) and tab.unique else None
        return rel

    @staticmethod
    def _equals(col: Column, kind: str, template: str, x) -> Column | None:
        if isinstance(x, Iri):
            return col.cast("string") == x.text[len(template) :] if kind == "iri" and x.text.startswith(template) else None
        if not isinstance(x, Lit):
            return None
        if kind == "str":
            return col == x.lex if x.lang is None and x.datatype in (None, T.XSD + "string") else None
        if kind in ("int", "num"):
            return col == F.lit(x.lex).cast("double") if x.datatype in T.NUMERIC else None
        if kind == "ts":
            return col == T.universal_time(F.lit(x.lex)) if x.datatype in (T.XSD + "dateTime", T.XSD + "date") else None
        return col == F.lit(x.lex in ("true", "1")) if kind == "bool" and x.datatype == T.XSD + "boolean" else None

    @staticmethod
    def _candidates(tab: Table, o) -> list[tuple[str, str | None, str, str]]:
        """Predicate, column (None: the class), kind and template of what a variable
        predicate can be, given the object."""
        ways = [(T.RDF_TYPE, None, "iri", tab.cls)]
        for predicate, c in tab.columns.items():
            source = c[0] if isinstance(c, tuple) else c
            if source not in tab.df.columns:
                raise QueryError(f"a computed column can't be reached by a variable predicate: {source}")
            ways.append((predicate, source, *tab.object(predicate)[1:]))
        if isinstance(o, Var):
            return ways
        if isinstance(o, Iri):
            return [w for w in ways if w[2] == "iri" and (o.text.startswith(w[3]) if w[1] else o.text == w[3])]
        return [w for w in ways if w[2] != "iri"] if isinstance(o, Lit) else []

    def _any_predicate(self, tab: Table, rel: Relation, row: str, t: Triple, ways: list) -> Relation:
        from quadrille.plans.relation import term_column

        pairs = [F.struct(F.lit(f"<{predicate}>").alias("p"), (term_column(F.col(f"{row}.{source}"), kind, template) if source else F.lit(f"<{tab.cls}>")).alias("o")) for predicate, source, kind, template in ways]
        if isinstance(t.o, Iri) and all(source for _, source, _, _ in ways):  # before terms are built
            rel = Relation(rel.df.where(reduce(lambda x, y: x | y, [F.col(f"{row}.{source}").cast("string") == t.o.text[len(template) :] for _, source, _, template in ways])), rel.vars)
        e = fresh()
        df = rel.df.withColumn(e, F.explode(F.array(*pairs))).where(F.col(f"{e}.o").isNotNull())
        out, cols = dict(rel.vars), [F.col(b.col) for b in rel.vars.values()] + [F.col(row)]
        for x, name in ((t.p, "p"), (t.o, "o")):
            if not isinstance(x, Var):
                df = df.where(F.col(f"{e}.{name}") == constant_term(x))
            elif x.name in out:
                b = out[x.name]
                df = df.where(term_column(F.col(b.col), b.kind, b.template) == F.col(f"{e}.{name}"))
            else:
                out[x.name] = Binding(fresh(), "term")
                cols.append(F.col(f"{e}.{name}").alias(out[x.name].col))
        return Relation(df.select(*cols), out)


EX = "http://ex/"


def driver_graph(spark: SparkSession, sf_dir: str) -> MappedGraph:
    """The relational test tables as one graph in the namespace http://ex/."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def node(name: str) -> str:
        return f"{EX}{name}/"

    def table(name: str, cls: str, key: str | None, columns: dict, template: str | None = None) -> Table:
        return Table(partial(read, name), EX + cls, template or node(name), key, {EX + p: c for p, c in columns.items()})

    def read_turns() -> DataFrame:
        """Each turn with the key of the one after it."""
        later = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
        return read("conversations").withColumn("next_turn", F.when(later.isNotNull(), F.concat_ws("-", "conv_id", later)))

    turns = Table(read_turns, EX + "Turn", node("conversations"), "concat_ws('-', conv_id, turn)", {EX + p: c for p, c in {"conv": "conv_id", "turn": "turn", "role": "role", "body": "text", "next": ("next_turn", node("conversations"))}.items()})
    return MappedGraph(
        spark,
        [
            table("region", "Region", "r_regionkey", {"name": "r_name"}),
            table("nation", "Nation", "n_nationkey", {"name": "n_name", "region": ("n_regionkey", node("region"))}),
            table("customer", "Customer", "c_custkey", {"name": "c_name", "acctbal": "c_acctbal", "segment": "c_mktsegment", "nation": ("c_nationkey", node("nation"))}),
            table("supplier", "Supplier", "s_suppkey", {"name": "s_name", "acctbal": "s_acctbal", "nation": ("s_nationkey", node("nation"))}),
            table("part", "Part", "p_partkey", {"name": "p_name", "brand": "p_brand", "ptype": "p_type", "size": "p_size", "retailPrice": "p_retailprice"}),
            table("orders", "Order", "o_orderkey", {"status": "o_orderstatus", "totalPrice": "o_totalprice", "orderDate": "o_orderdate", "priority": "o_orderpriority", "customer": ("o_custkey", node("customer"))}),
            table(
                "lineitem",
                "Lineitem",
                None,
                {"order": ("l_orderkey", node("orders")), "part": ("l_partkey", node("part")), "supplier": ("l_suppkey", node("supplier")), "lineNumber": "l_linenumber", "quantity": "l_quantity", "extendedPrice": "l_extendedprice"}
                | {"discount": "l_discount", "tax": "l_tax", "returnFlag": "l_returnflag", "lineStatus": "l_linestatus", "shipDate": "l_shipdate"},
            ),
            table("events", "Event", "event_id", {"at": "ts", "user": ("user_id", node("user")), "eventType": "event_type", "value": "value", "props": "props"}),
            table("documents", "Document", "doc_id", {"text": "text", "lang": "lang", "source": "source", "nChars": "n_chars"}),
            table("labels", "Label", "doc_id", {"quality": "quality", "toxic": "toxic"}, node("documents")),
            turns,
            table("pages", "Page", "page_id", {"url": "url", "html": "html"}),
            table("benchmark", "Item", "item_id", {"itemText": "text"}),
            table("embeddings", "Vector", "vec_id", {"vecLabel": "label"}),
        ],
    )
