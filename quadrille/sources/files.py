"""Reading and writing triples in files: N-Triples (splittable, all in Spark) and Turtle
(a file is one statement stream, parsed whole by one task)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import terms as T
from quadrille.plans.syntax import Parser, QueryError
from quadrille.sources.graph import TripleGraph, constant_term

_NT = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+?|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'
_UNICODE = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}"
# Ranges of the bounded integer datatypes.
_RANGES = {"long": 63, "int": 31, "short": 15, "byte": 7}


def well_typed(o: Column) -> Column:
    """False for integers out of their datatype's range and for NaN."""

    def has(name: str) -> Column:
        return o.startswith('"') & o.endswith(f'"^^<{T.XSD}{name}>')

    most = F.lit(None).cast("decimal(20,0)")
    for name, bits in _RANGES.items():
        most = F.when(has(name), F.lit(str((1 << bits) - 1)).cast("decimal(20,0)")).otherwise(most)
    inside = F.coalesce(T.lexical(o).try_cast("decimal(38,0)").between(-most - 1, most), F.lit(False))
    nan = (has("float") | has("double")) & (F.upper(F.left(o, F.lit(5))) == '"NAN"')
    return F.when(most.isNotNull(), inside).otherwise(~nan)


def _canonical(df: DataFrame) -> DataFrame:
    plain = f"^^<{T.XSD}string>"
    o = F.when(F.endswith("o", F.lit(plain)), F.expr(f"left(o, length(o) - {len(plain)})")).otherwise(F.col("o"))
    return df.where(well_typed(F.col("o"))).withColumn("o", o)


def _plain_characters(term: Column) -> Column:
    """A term whose escapes by code point are the characters that they stand for."""
    marks = F.array_distinct(F.regexp_extract_all(term, F.lit(_UNICODE), F.lit(0)))
    # UTF-16 units, so that a character beyond 16 bits is a pair
    code = lambda m: F.conv(F.substring(m, F.lit(3), F.length(m)), 16, 10).cast("int")
    unit = lambda n: F.unhex(F.lpad(F.hex(n), 4, "0"))
    high, low = lambda n: F.lit(0xD7C0) + F.shiftright(n, 10), lambda n: F.lit(0xDC00) + n.bitwiseAND(F.lit(0x3FF))
    text = lambda n: F.decode(F.when(n < 0x10000, unit(n)).otherwise(F.concat(unit(high(n)), unit(low(n)))), "UTF-16BE")
    # an escaped backslash before u is no mark: hide those while marks are replaced
    hidden = F.replace(term, F.lit("\\\\"), F.lit("\x00"))
    out = F.aggregate(marks, hidden, lambda acc, m: F.replace(acc, m, T.escape(text(code(m)))))
    return F.when(F.instr(term, "\\u") + F.instr(term, "\\U") > 0, F.replace(out, F.lit("\x00"), F.lit("\\\\"))).otherwise(term)


def _once(df: DataFrame, columns: list[Column]) -> DataFrame:
    """The columns, computed once a row wherever later filters use them."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def _plain_lines(lines: DataFrame) -> DataFrame:
    """Lines with s, p, o of those that are three terms with a blank between, a full stop
    and no escape, tag or blank node, as most are: found without a regular expression. Of
    others ``plain`` is false."""
    at = lambda part, c, pos=1: F.locate(part, F.col(c), pos)
    rest = lambda c, i: F.substring(c, i, F.length(c))
    df = lines.select("value", at("> <", "value").alias("i"))
    df = df.select("value", "i", F.left("value", F.col("i")).alias("s"), rest("value", F.col("i") + 2).alias("rest"))
    df = df.select("value", "i", "s", "rest", at("> ", "rest").alias("j"))
    df = df.select("value", "i", "s", "j", F.left("rest", F.col("j")).alias("p"), F.substring("rest", F.col("j") + 2, F.length("rest") - F.col("j") - 3).alias("o"))
    df = df.select("*", at('"', "o", 2).alias("k"), F.length("o").alias("n"))
    typed = (F.substring("o", F.col("k") + 1, F.lit(3)) == "^^<") & (F.length(F.substring_index(rest("o", F.col("k") + 1), ">", 1)) == F.col("n") - F.col("k") - 1)
    literal = F.startswith("o", F.lit('"')) & (F.col("k") > 0) & ((F.col("k") == F.col("n")) | F.endswith("o", F.lit(">")) & typed)
    iri = F.startswith("o", F.lit("<")) & (at(">", "o") == F.col("n"))
    ends = F.startswith("value", F.lit("<")) & F.endswith("value", F.lit(" .")) & (F.instr("value", "\\") == 0)
    plain = ends & (F.col("i") > 0) & (at(">", "s") == F.col("i")) & (F.col("j") > 0) & (at(">", "p") == F.col("j")) & (iri | literal)
    return df.select("value", "s", "p", "o", F.coalesce(plain, F.lit(False)).alias("plain"))


def ntriples_terms(lines: DataFrame) -> DataFrame:
    """s, p, o of lines (column value); lines that are no triple are skipped."""
    terms = _once(_plain_lines(lines), [F.when(F.col("plain"), F.col(n)).otherwise(F.regexp_extract("value", _NT, i)).alias(n) for i, n in ((1, "s"), (2, "p"), (3, "o"))]).where("s <> ''")
    return _canonical(_once(terms, [_plain_characters(F.col(n)).alias(n) for n in "spo"]))


def parse_ntriples(lines: DataFrame) -> TripleGraph:
    return TripleGraph.of(ntriples_terms(lines))


def read_ntriples(spark: SparkSession, path: str) -> TripleGraph:
    return parse_ntriples(spark.read.text(path))


class TurtleParser(Parser):
    def statements(self) -> Iterator[tuple[str, str, str]]:
        """Triples of all statements; one that can't be parsed is skipped to its end."""
        while self.kind() != "end":
            out: list = []
            try:
                word = self.tokens[self.at][1].lower()
                if word in ("@prefix", "@base"):
                    self.at += 1
                    if word == "@prefix":
                        name = self.next("name")
                        self.prefixes[name.rpartition(":")[0]] = self.iri().text
                    else:
                        self.base = self.next("iri")[1:-1]
                    self.need(".")
                elif self.peek("prefix", "base"):
                    self.prologue()
                else:
                    self.triples(out)
                    if self.kind() != "end":
                        self.need(".")
                    if any(type(x).__name__ in ("Var", "Path") for t in out for x in (t.s, t.p, t.o)):
                        raise QueryError("not a triple of terms")
            except QueryError:
                out = []
                while self.kind() != "end" and not self.take("."):
                    self.at += 1
            for t in out:
                yield constant_term(t.s), constant_term(t.p), constant_term(t.o)


def parse_turtle(text: str) -> list[tuple[str, str, str]]:
    return list(TurtleParser(text).statements())


def read_turtle(spark: SparkSession, path: str) -> TripleGraph:
    """Blank node labels are kept apart between files."""
    files = spark.read.text(path, wholetext=True).select("value", F.md5("value").alias("file"))

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text, file in zip(frame["value"], frame["file"], strict=True):
                rows = [tuple(x + "x" + file[:8] if x.startswith("_:") else x for x in t) for t in parse_turtle(text)]
                yield pd.DataFrame(rows, columns=["s", "p", "o"])

    return TripleGraph.of(_canonical(files.mapInPandas(parse, "s string, p string, o string")))


def from_text(spark: SparkSession, text: str) -> TripleGraph:
    """A small graph written out in Turtle."""
    return TripleGraph.of(_canonical(spark.createDataFrame(parse_turtle(text), "s string, p string, o string")))


def ntriples_lines(df: DataFrame) -> DataFrame:
    """value: a line for each triple."""
    return df.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"))


def write_ntriples(df: DataFrame, path: str) -> None:
    ntriples_lines(df).write.text(path)
