"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. ``run`` applies them in turn, each to what its predecessor kept.
"""

from quadrille.llm.stages import encode, exact, language, mixture, near

STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_jaccard", near), ("mix_sources", mixture), ("sentencepiece", encode)]

#: SQL can't express the language models, MinHash classes or Viterbi paths.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
