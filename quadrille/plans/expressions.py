"""Expressions as typed columns. An error is null, so three-valued logic is SQL's."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions import terms as T
from quadrille.plans.relation import Binding, term_column
from quadrille.plans.syntax import Call, Iri, Lit, QueryError, Var


@dataclass
class Value:
    col: Column
    kind: str  # term, iri, int, num, str, ts, bool
    template: str = ""


#: Functions under an IRI, added by ``register_function``: columns in, (column, kind) out.
CUSTOM: dict[str, Callable] = {}


def register_function(iri: str, build: Callable) -> None:
    """build(*columns) -> (column, kind); columns hold native values."""
    CUSTOM[iri] = build


def constant(x) -> Value:
    if isinstance(x, Iri):
        return Value(F.lit(x.text), "iri")
    if x.lang is None and x.datatype in (None, T.XSD + "string"):
        return Value(F.lit(x.lex), "str")
    if x.datatype == T.XSD + "integer":
        return Value(F.lit(x.lex).try_cast("bigint"), "int") if abs(int(x.lex)) >= 1 << 31 else Value(F.lit(int(x.lex)).cast("bigint"), "int")
    if x.datatype in T.NUMERIC:
        return Value(F.lit(x.lex).try_cast("double"), "num")
    if x.datatype == T.XSD + "boolean":
        return Value(F.lit(x.lex in ("true", "1")), "bool")
    if x.datatype in (T.XSD + "dateTime", T.XSD + "date") and not re.search(r"(Z|[+-]\d\d:\d\d)$", x.lex):
        return Value(F.lit(x.lex).try_cast("timestamp_ntz"), "ts")
    from quadrille.sources.graph import constant_term

    return Value(F.lit(constant_term(x)), "term")


def of_binding(b: Binding) -> Value:
    return Value(F.col(b.col), b.kind, b.template)


def term(v: Value) -> Column:
    return term_column(v.col, v.kind, v.template)


def number(v: Value) -> Column:
    return v.col if v.kind in ("int", "num") else T.number(v.col) if v.kind == "term" else F.lit(None).cast("double")


def string(v: Value) -> Column:
    """The value of a plain or tagged string, else null."""
    return v.col if v.kind == "str" else T.string(v.col) if v.kind == "term" else F.lit(None).cast("string")


def lexical(v: Value) -> Column:
    if v.kind == "term":
        return T.lexical(v.col)
    if v.kind == "iri":
        return F.concat(F.lit(v.template), v.col.cast("string"))
    return F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss") if v.kind == "ts" else v.col.cast("string")


def moment(v: Value) -> Column:
    return v.col if v.kind == "ts" else T.timestamp(v.col) if v.kind == "term" else F.lit(None).cast("timestamp_ntz")


def clock(v: Value) -> Column:
    """A moment as its own zone has it."""
    return T.local_timestamp(v.col) if v.kind == "term" else moment(v)


def _texts(a: Value, text: Column) -> Value:
    """A string made of ``a``, with its language tag."""
    return Value(T.with_tag_of(a.col, text), "term") if a.kind == "term" else Value(text, "str")


def truth(v: Value) -> Column:
    """Effective boolean value."""
    if v.kind == "bool":
        return v.col
    if v.kind in ("int", "num"):
        return (v.col != 0) & ~F.isnan(v.col.cast("double"))
    if v.kind == "str":
        return v.col != ""
    if v.kind == "term":
        return F.coalesce(T.boolean(v.col), T.number(v.col) != 0, T.string(v.col) != "")
    return F.lit(None).cast("boolean")


_NUMBERS = {"int", "num"}


def equal(a: Value, b: Value) -> Column:
    if a.kind == b.kind and a.kind != "term":
        if a.kind == "iri" and a.template != b.template:
            return lexical(a) == lexical(b)
        return a.col == b.col
    if {a.kind, b.kind} <= _NUMBERS:
        return a.col == b.col
    if "term" not in (a.kind, b.kind):
        return F.when(a.col.isNotNull() & b.col.isNotNull(), False)
    same = term(a) == term(b)
    if a.kind in _NUMBERS or b.kind in _NUMBERS or a.kind == b.kind:
        x, y = number(a).cast("double"), number(b).cast("double")
        same = F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(same)
    if a.kind == "ts" or b.kind == "ts" or a.kind == b.kind:
        x, y = moment(a), moment(b)
        same = F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(same)
    return same


def less(a: Value, b: Value, test: Callable[[Column, Column], Column]) -> Column:
    """Order comparison; null between values of different classes."""
    ways = []
    if {a.kind, b.kind} <= _NUMBERS | {"term"}:
        ways.append(test(number(a), number(b)))
    if {a.kind, b.kind} <= {"ts", "term"}:
        ways.append(test(moment(a), moment(b)))
    if {a.kind, b.kind} <= {"str", "term"}:
        ways.append(test(string(a), string(b)))
    if a.kind == b.kind == "bool":
        ways.append(test(a.col, b.col))
    return F.coalesce(*ways) if ways else F.lit(None).cast("boolean")


def _arith(op: str, a: Value, b: Value) -> Value:
    x, y = number(a), number(b)
    whole = a.kind == b.kind == "int"
    if op == "/":
        return Value(F.try_divide(x.cast("double"), y.cast("double")), "num")
    if not whole:
        x, y = x.cast("double"), y.cast("double")
    f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
    return Value(f(x, y), "int" if whole else "num")


def _java_pattern(pattern: Column, flags: Column | None) -> Column:
    return pattern if flags is None else F.when(flags == "", pattern).otherwise(F.concat(F.lit("(?"), flags, F.lit(")"), pattern))


def common(values: list[Value]) -> tuple[list[Column], str, str]:
    """Columns of one kind for the values of an if or coalesce."""
    kinds = {(v.kind, v.template) for v in values}
    if len(kinds) == 1:
        return [v.col for v in values], values[0].kind, values[0].template
    if {v.kind for v in values} <= _NUMBERS:
        return [v.col.cast("double") for v in values], "num", ""
    return [term(v) for v in values], "term", ""


def datatype(v: Value) -> Column:
    known = {"int": "integer", "num": "double", "str": "string", "ts": "dateTime", "bool": "boolean"}
    if v.kind in known:
        return F.when(v.col.isNotNull(), F.lit(T.XSD + known[v.kind]))
    return T.datatype(v.col) if v.kind == "term" else F.lit(None).cast("string")


def _is(v: Value, test: Callable[[Column], Column], kinds: set[str]) -> Value:
    return Value(test(v.col) if v.kind == "term" else F.when(v.col.isNotNull(), F.lit(v.kind in kinds)), "bool")


_LITERALS = {"int", "num", "str", "ts", "bool"}


def call(name: str, args: list[Value]) -> Value:  # noqa: PLR0911, PLR0912
    a = args[0] if args else None
    if name in ("||", "&&"):
        parts = [truth(x) for x in args]
        return Value(reduce((lambda x, y: x | y) if name == "||" else (lambda x, y: x & y), parts), "bool")
    if name == "!":
        return Value(~truth(a), "bool")
    if name == "=":
        return Value(equal(a, args[1]), "bool")
    if name == "!=":
        return Value(~equal(a, args[1]), "bool")
    if name in ("<", "<=", ">", ">="):
        test = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[name]
        return Value(less(a, args[1], test), "bool")
    if name in ("in", "notin"):
        found = reduce(lambda x, y: x | y, [equal(a, x) for x in args[1:]], F.lit(False))
        return Value(found if name == "in" else ~found, "bool")
    if name in ("+", "-", "*", "/"):
        return _arith(name, a, args[1])
    if name == "neg":
        return Value(-number(a), a.kind if a.kind in _NUMBERS else "num")
    if name == "regex":
        flags = string(args[2]) if len(args) > 2 else None
        return Value(F.regexp_like(string(a), _java_pattern(string(args[1]), flags)), "bool")
    if name == "str":
        return Value(lexical(a), "str")
    if name == "lang":
        return Value(T.language(a.col) if a.kind == "term" else F.when(a.col.isNotNull() & F.lit(a.kind in _LITERALS), F.lit("")), "str")
    if name == "langmatches":
        tag, want = F.lower(string(a)), F.lower(string(args[1]))
        return Value(F.when(want == "*", tag != "").otherwise((tag == want) | tag.startswith(F.concat(want, F.lit("-")))), "bool")
    if name == "datatype":
        return Value(datatype(a), "iri")
    if name in ("isiri", "isuri"):
        return _is(a, T.is_iri, {"iri"})
    if name == "isliteral":
        return _is(a, T.is_literal, _LITERALS)
    if name == "isblank":
        return _is(a, T.is_blank, set())
    if name == "isnumeric":
        return _is(a, lambda c: F.when(c.isNotNull(), T.number(c).isNotNull()), _NUMBERS)
    if name == "sameterm":
        return Value(term(a) == term(args[1]), "bool")
    if name == "if":
        cols, kind, template = common(args[1:])
        test = truth(a)
        return Value(F.when(test, cols[0]).when(~test, cols[1]), kind, template)
    if name == "coalesce":
        cols, kind, template = common(args)
        return Value(F.coalesce(*cols), kind, template)
    if name in ("contains", "strstarts", "strends"):
        f = {"contains": F.contains, "strstarts": F.startswith, "strends": F.endswith}[name]
        return Value(f(string(a), string(args[1])), "bool")
    if name in ("ucase", "lcase"):
        return _texts(a, (F.upper if name == "ucase" else F.lower)(string(a)))
    if name == "strlen":
        return Value(F.length(string(a)).cast("bigint"), "int")
    if name == "substr":  # positions p with start <= p < start + size, both rounded
        text, start = string(a), F.floor(number(args[1]) + 0.5).cast("int")
        end = F.length(text) + 1 if len(args) < 3 else start + F.floor(number(args[2]) + 0.5).cast("int")
        first = F.greatest(start, F.lit(1))
        # greatest and least skip nulls
        cut = F.when(start.isNotNull() & end.isNotNull(), F.substring(text, first, F.greatest(end - first, F.lit(0))))
        return _texts(a, cut)
    if name == "concat":
        text = F.concat(*[string(x) for x in args])
        if any(x.kind != "term" for x in args):
            return Value(text, "str")
        same = reduce(lambda x, y: x & y, [T.language(x.col) == T.language(a.col) for x in args])
        return Value(F.when(same, T.with_tag_of(a.col, text)).otherwise(T.literal(text)), "term")
    if name in ("strbefore", "strafter"):
        s, part = string(a), string(args[1])
        at = F.instr(s, part)
        cut = F.substring(s, F.lit(1), at - 1) if name == "strbefore" else F.substring(s, at + F.length(part), F.length(s))
        none = F.when(s.isNotNull() & part.isNotNull(), F.lit(""))
        if a.kind == "term":  # without a match, an empty string without a tag
            return Value(F.when(at > 0, T.with_tag_of(a.col, cut)).otherwise(T.literal(none)), "term")
        return Value(F.when(at > 0, cut).otherwise(none), "str")
    if name == "replace":
        flags = string(args[3]) if len(args) > 3 else None
        return _texts(a, F.regexp_replace(string(a), _java_pattern(string(args[1]), flags), string(args[2])))
    if name == "encode_for_uri":
        return Value(F.replace(F.replace(F.replace(F.url_encode(string(a)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")), "str")
    if name in ("abs", "ceil", "floor", "round"):
        x = number(a)
        if a.kind == "int":
            return Value(F.abs(x) if name == "abs" else x, "int")
        half_up = F.floor(x + 0.5)
        return Value({"abs": F.abs(x), "ceil": F.ceil(x), "floor": F.floor(x), "round": half_up}[name].cast("double"), "num")
    if name == "rand":
        return Value(F.rand(), "num")
    if name in ("year", "month", "day", "hours", "minutes"):
        f = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hours": F.hour, "minutes": F.minute}[name]
        return Value(f(clock(a)).cast("bigint"), "int")
    if name == "seconds":
        at = clock(a)
        return Value(F.second(at) + F.date_format(at, "SSSSSS").cast("double") / 1e6, "num")
    if name == "tz":
        return Value(F.when(clock(a).isNotNull(), T.zone(lexical(a))), "str")
    if name == "timezone":  # a day-time duration; an error without a zone
        def duration(at: Column) -> Column:
            hours, minutes = F.substring(at, 2, 2).try_cast("int"), F.substring(at, 5, 2).try_cast("int")
            parts = F.concat(F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
            text = F.when((at == "Z") | (parts == ""), F.lit("PT0S")).otherwise(F.concat(F.when(at.startswith("-"), F.lit("-PT")).otherwise(F.lit("PT")), parts))
            return F.when(at != "", T.literal(text, T.XSD + "dayTimeDuration"))

        at = F.when(clock(a).isNotNull(), T.zone(lexical(a)))
        return Value(F.get(F.transform(F.array(at), duration), 0), "term")  # the zone is computed once
    if name == "now":
        return Value(F.current_timestamp().cast("timestamp_ntz"), "ts")
    if name in ("iri", "uri"):
        return Value(lexical(a), "iri")
    if name == "bnode":
        return Value(F.concat(F.lit("_:"), F.md5(lexical(a)) if a else F.replace(F.uuid(), F.lit("-"), F.lit(""))), "term")
    if name == "strlang":
        return Value(F.concat(F.lit('"'), T.escape(string(a)), F.lit('"@'), F.lower(string(args[1]))), "term")
    if name == "strdt":
        return Value(F.concat(F.lit('"'), T.escape(string(a)), F.lit('"^^<'), lexical(args[1]), F.lit(">")), "term")
    if name == "uuid":
        return Value(F.concat(F.lit("urn:uuid:"), F.uuid()), "iri")
    if name == "struuid":
        return Value(F.uuid(), "str")
    if name in ("md5", "sha1"):
        return Value((F.md5 if name == "md5" else F.sha1)(string(a)), "str")
    if name in ("sha256", "sha384", "sha512"):
        return Value(F.sha2(string(a), int(name[3:])), "str")
    if name == T.XSD + "integer":
        return Value(lexical(a).try_cast("double").try_cast("bigint"), "int")
    if name in (T.XSD + "double", T.XSD + "decimal", T.XSD + "float"):
        return Value(lexical(a).try_cast("double"), "num")
    if name == T.XSD + "string":
        return Value(lexical(a), "str")
    if name == T.XSD + "boolean":
        if a.kind in ("bool", "int", "num"):
            return Value(truth(a), "bool")
        text = lexical(a)
        known = F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)
        return Value(known if a.kind != "term" else F.coalesce(T.number(a.col) != 0, known), "bool")
    if name in (T.XSD + "dateTime", T.XSD + "date"):
        at = a.col if a.kind == "ts" else T.local_time(lexical(a))
        style = "yyyy-MM-dd" if name.endswith("#date") else "yyyy-MM-dd'T'HH:mm:ss"
        if a.kind == "ts" and name.endswith("#dateTime"):
            return a
        return Value(T.literal(F.concat(F.date_format(at, style), F.lit("") if a.kind == "ts" else T.zone(lexical(a))), name), "term")
    if name in CUSTOM:
        return Value(*CUSTOM[name](*[x.col for x in args]))
    raise QueryError(f"unknown function {name}")


def evaluate(e, scope: dict[str, Binding], special: dict[int, Value]) -> Value:
    """``special``: values of nodes that were computed beforehand (aggregates, path calls)."""
    if id(e) in special:
        return special[id(e)]
    if isinstance(e, Var):
        return of_binding(scope[e.name]) if e.name in scope else Value(F.lit(None).cast("string"), "term")
    if isinstance(e, (Iri, Lit)):
        return constant(e)
    if isinstance(e, Call):
        if e.name == "bound":
            return Value(F.col(scope[e.args[0].name].col).isNotNull() if e.args[0].name in scope else F.lit(False), "bool")
        return call(e.name, [evaluate(x, scope, special) for x in e.args])
    raise QueryError(f"{type(e).__name__} can't be used here")
