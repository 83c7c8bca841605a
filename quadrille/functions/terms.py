"""Columns of canonical term strings and what can be read from them.

A term is ``<iri>``, ``_:label``, ``"lex"``, ``"lex"@lang`` or ``"lex"^^<datatype>``; in a
lexical form backslash, quote, line feed, carriage return and tab are escaped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
# The datatypes that compare as numbers.
NUMERIC = [XSD + x for x in ("integer", "decimal", "float", "double", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")]
# Those that are integers.
WHOLE = [x for x in NUMERIC if x.rpartition("#")[2] not in ("decimal", "float", "double")]
_ZONE = r"(Z|[+-]\d\d:\d\d)$"
_BODY = r'(?s)^"(.*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?$'


def escape(lex: Column) -> Column:
    out = F.replace(lex, F.lit("\\"), F.lit("\\\\"))
    for raw, esc in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(esc))
    return out


def unescape(lex: Column) -> Column:
    out = F.replace(lex, F.lit("\\\\"), F.lit("\u0000"))
    for raw, esc in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(esc), F.lit(raw))
    return F.when(F.instr(lex, "\\") > 0, F.replace(out, F.lit("\u0000"), F.lit("\\"))).otherwise(lex)


def iri(text: Column) -> Column:
    return F.concat(F.lit("<"), text, F.lit(">"))


def literal(lex: Column, datatype: str | None = None, lang: str | None = None) -> Column:
    tail = f"^^<{datatype}>" if datatype and datatype != XSD + "string" else f"@{lang}" if lang else ""
    return F.concat(F.lit('"'), escape(lex), F.lit('"' + tail))


def is_iri(term: Column) -> Column:
    return term.startswith("<")


def is_blank(term: Column) -> Column:
    return term.startswith("_:")


def is_literal(term: Column) -> Column:
    return term.startswith('"')


def lexical(term: Column) -> Column:
    """str(): the lexical form of a literal, the text of an IRI; null for a blank node."""
    return F.when(is_literal(term), unescape(F.regexp_extract(term, _BODY, 1))).when(is_iri(term), F.substring(term, F.lit(2), F.length(term) - 2))


def language(term: Column) -> Column:
    return F.when(is_literal(term), F.regexp_extract(term, _BODY, 2))


def datatype(term: Column) -> Column:
    """Datatype IRI (text) of a literal."""
    got = F.regexp_extract(term, _BODY, 3)
    return F.when(is_literal(term), F.when(got != "", got).when(language(term) != "", F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")).otherwise(F.lit(XSD + "string")))


def number(term: Column) -> Column:
    """Value of a numeric literal as a double, else null."""
    return F.when(datatype(term).isin(NUMERIC), lexical(term).try_cast("double"))


def any_number(term: Column) -> Column:
    """Value of any literal whose whole lexical form is a number (scores of top-k)."""
    return F.when(is_literal(term), lexical(term).try_cast("double"))


def zone(lex: Column) -> Column:
    """Z, an offset, or an empty string."""
    return F.regexp_extract(lex, _ZONE, 1)


def local_time(lex: Column) -> Column:
    """What a date and time says, whatever its zone."""
    return F.regexp_replace(lex, _ZONE, "").try_cast("timestamp_ntz")


def universal_time(lex: Column) -> Column:
    """A date and time in UTC; one without a zone counts as UTC."""
    at = zone(lex)
    hours, minutes = F.substring(at, 2, 2).try_cast("int"), F.substring(at, 5, 2).try_cast("int")
    offset = F.make_dt_interval(F.lit(0), hours, minutes, F.lit(0))
    local = local_time(lex)
    return F.when(at.startswith("+"), local - offset).when(at.startswith("-"), local + offset).otherwise(local)


def _moment(term: Column, of) -> Column:
    return F.when(datatype(term).isin(XSD + "dateTime", XSD + "date"), of(lexical(term)))


def timestamp(term: Column) -> Column:
    """Value of a dateTime or date in UTC, by which they compare."""
    return _moment(term, universal_time)


def local_timestamp(term: Column) -> Column:
    """Value of a dateTime or date in its own zone, whose parts functions give."""
    return _moment(term, local_time)


def with_tag_of(term: Column, text: Column) -> Column:
    """A string literal of ``text`` with the language tag of ``term``, if it has one."""
    tag = language(term)
    return F.concat(F.lit('"'), escape(text), F.lit('"'), F.when(tag != "", F.concat(F.lit("@"), tag)).otherwise(F.lit("")))


def boolean(term: Column) -> Column:
    return F.when(datatype(term) == XSD + "boolean", F.when(lexical(term).isin("true", "1"), True).when(lexical(term).isin("false", "0"), False))


def string(term: Column) -> Column:
    """Value of a plain, tagged or xsd:string literal."""
    return F.when(datatype(term).isin(XSD + "string", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"), lexical(term))
