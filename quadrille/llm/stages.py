"""The pipeline's stages: each applies one operator's decisions to a table of documents.

Every stage takes (spark, docs, sf_dir) and works on all rows and whole texts of ``docs``;
doc_id, text, lang and source are used, further columns are carried along whatever their
names. In all of them an empty table gives an empty one, and rows of null or repeated
doc_ids are rows like any other.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.exact_dedup import keep_one
from quadrille.llm.jaccard import keep_apart
from quadrille.llm.language_id import keep_identified
from quadrille.llm.mixing import in_mixed_order, mix_sources
from quadrille.llm.pieces import decode_pieces, encode_pieces


def language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the learnt languages, or without letters, go.

    Null, empty and letterless texts have no language and go. Where no row is labelled,
    nothing can be judged and all rows stay. Equal texts are judged alike."""
    return keep_identified(docs)


def exact(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts stays: the one with the largest doc_id.

    Null counts as empty; a null doc_id is smaller than all others; of rows that tie in
    doc_id one stays, whichever their other columns."""
    return keep_one(docs)


def near(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one with the least doc_id, or
    a text without a doc_id of its own where the class has one.

    Rows go by their texts, so a clean text under a repeated doc_id stays. Texts of fewer
    than five words, null and empty ones are only copies of equal texts."""
    return keep_apart(docs)


def mixture(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order in which the mixture is read: sorted files.

    No row goes. A null source is a source of its own; only rows that repeat doc_id and
    text tie, in any order."""
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("__row"))
    return in_mixed_order(mix_sources(rows, carry=("__row",))).select("__row.*")


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, token_ids of every document, and the text that they decode
    to, which is its own.

    A null text has null pieces and stays null; an empty one has none."""
    encoded = encode_pieces(docs.select("doc_id", "source", "text"), carry=("source",))
    return decode_pieces(encoded.withColumn("ids", F.col("token_ids")), carry=("source", "n_tokens", "ids")).withColumnRenamed("ids", "token_ids")
