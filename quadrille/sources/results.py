"""Result sinks: tab-separated text and the JSON results format. Frames hold canonical
terms (``run(..., terms=True)``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import terms as T


def tsv_rows(df: DataFrame) -> DataFrame:
    """One column of text lines, without the header."""
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c), F.lit("")) for c in df.columns]).alias("value"))


def to_tsv(df: DataFrame) -> str:
    """The whole result as text for a person to read; use ``tsv_rows`` to write large ones."""
    lines = [r[0] for r in tsv_rows(df).toLocalIterator()]
    return "\n".join(["\t".join("?" + c for c in df.columns), *(lines or ["[empty result]"])]) + "\n"


def _binding(c: Column) -> Column:
    kind = F.when(T.is_iri(c), "uri").when(T.is_blank(c), "bnode").otherwise("literal")
    typed = T.datatype(c)
    shown = F.when(T.is_literal(c) & ~typed.isin(T.XSD + "string", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"), typed)
    lang = T.language(c)
    value = F.when(T.is_blank(c), F.substring(c, F.lit(3), F.length(c))).otherwise(T.lexical(c))
    return F.when(c.isNotNull(), F.struct(kind.alias("type"), value.alias("value"), F.when(lang != "", lang).alias("xml:lang"), shown.alias("datatype")))


def json_bindings(df: DataFrame) -> DataFrame:
    """One column of JSON objects, a solution each."""
    return df.select(F.to_json(F.struct(*[_binding(F.col(c)).alias(c) for c in df.columns])).alias("value"))


def to_json(df: DataFrame) -> str:
    import json

    rows = [json.loads(r[0]) for r in json_bindings(df).toLocalIterator()]
    return json.dumps({"head": {"vars": df.columns}, "results": {"bindings": rows}})
