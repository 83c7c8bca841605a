"""The contract queries over the driver's tables: one for each operator."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.exact_dedup import exact_dedup
from quadrille.llm.jaccard import ngram_jaccard
from quadrille.llm.language_id import identify_language
from quadrille.llm.license_scan import COPYRIGHT_LINE, LICENSES, OWN_WORDS, SPELLINGS, license_scan
from quadrille.llm.lm_score import lm_score
from quadrille.llm.merkle import fingerprint_with_next
from quadrille.llm.mixing import mix_sources
from quadrille.llm.pieces import decode_pieces, encode_pieces
from quadrille.llm.relative_lz import substring_dedup
from quadrille.llm.suffix_dedup import suffix_dedup


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lm_score(spark, sf_dir):
    """Stupid-backoff trigram score of every document against the corpus."""
    return lm_score(documents(spark, sf_dir)).select("doc_id", "n_words", F.round("log_score", 5).alias("log_score"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir))


def op3_substring_dedup(spark, sf_dir):
    return substring_dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_sentencepiece(spark, sf_dir):
    """Encodes and decodes every text: pieces, a digest of their ids, and whether the text
    came back."""
    rows = documents(spark, sf_dir).select("doc_id", "text", F.sha2("text", 256).alias("text_sha256"))
    encoded = encode_pieces(rows, carry=("text_sha256",))
    digest = F.sha2(F.concat_ws(",", "token_ids"), 256)
    decoded = decode_pieces(encoded.withColumn("ids_sha256", digest), carry=("text_sha256", "n_tokens", "ids_sha256"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", (F.sha2("text", 256) == F.col("text_sha256")).alias("round_trip"))


def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_license_scan(spark, sf_dir):
    return license_scan(documents(spark, sf_dir))


def op7_ngram_jaccard(spark, sf_dir):
    return ngram_jaccard(documents(spark, sf_dir))


def op8_language_id(spark, sf_dir):
    return identify_language(documents(spark, sf_dir))


def op9_fingerprints(spark, sf_dir):
    return fingerprint_with_next(documents(spark, sf_dir))


def op10_mix_sources(spark, sf_dir):
    return mix_sources(documents(spark, sf_dir))


def queries():
    return {f.__name__: f for f in (op1_lm_score, op2_exact_dedup, op3_substring_dedup, op4_sentencepiece, op5_suffix_dedup, op6_license_scan, op7_ngram_jaccard, op8_language_id, op9_fingerprints, op10_mix_sources)}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, w[i] AS a1, CASE WHEN i > 1 THEN w[i-1:i] END AS a2, CASE WHEN i > 2 THEN w[i-2:i] END AS a3 FROM p),
c1 AS (SELECT a1 AS k, count(*) AS n FROM g GROUP BY 1),
c2 AS (SELECT a2 AS k, count(*) AS n FROM g WHERE a2 IS NOT NULL GROUP BY 1),
c3 AS (SELECT a3 AS k, count(*) AS n FROM g WHERE a3 IS NOT NULL GROUP BY 1),
total AS (SELECT count(*) AS n FROM g),
s AS (
  SELECT g.doc_id, CASE
    WHEN c3.n IS NOT NULL THEN ln(c3.n / h2.n)
    WHEN c2.n IS NOT NULL THEN ln(c2.n / h1.n) + CASE WHEN g.i > 2 THEN ln(0.4) ELSE 0 END
    ELSE ln(c1.n / total.n) + least(g.i - 1, 2) * ln(0.4) END AS s
  FROM g JOIN c1 ON c1.k = g.a1 LEFT JOIN c2 ON c2.k = g.a2 LEFT JOIN c3 ON c3.k = g.a3
    LEFT JOIN c1 h1 ON h1.k = g.a2[1] LEFT JOIN c2 h2 ON h2.k = g.a3[1:2] CROSS JOIN total)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, round(x.s, 5) AS log_score
FROM d LEFT JOIN (SELECT doc_id, sum(s) AS s FROM s GROUP BY 1) x USING (doc_id)
"""

OP2 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

OP3 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, w[i:i+19] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 20)) AS i FROM dup),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.i) AS t FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _canonical_sql(column: str) -> str:
    t = rf"regexp_replace(lower(coalesce({column}, '')), '{OWN_WORDS}', '=\2', 'g')"
    t = f"regexp_replace({t}, '{COPYRIGHT_LINE}', ' ', 'g')"
    t = rf"trim(regexp_replace({t}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    for a, b in SPELLINGS.items():
        t = f"replace({t}, '{a}', '{b}')"
    return t


def _op6() -> str:
    known = ", ".join("('{}', '{}')".format(name, body.replace("'", "''")) for name, body in LICENSES)
    return f"""
WITH known AS (SELECT DISTINCT name, sha256({_canonical_sql('body')}) AS digest FROM (VALUES {known}) t(name, body))
SELECT doc_id, d.digest, name AS license_id FROM (SELECT doc_id, sha256({_canonical_sql('text')}) AS digest FROM documents) d LEFT JOIN known USING (digest)
"""


OP10 = """
WITH RECURSIVE c AS (SELECT source AS src, count(*) AS n FROM documents GROUP BY 1),
sh AS (SELECT src, CAST(greatest(1, floor(256.0::DOUBLE * pow(n::DOUBLE, 0.5::DOUBLE) / sum(pow(n::DOUBLE, 0.5::DOUBLE)) OVER ())) AS BIGINT) AS share FROM c),
s AS (SELECT list(src ORDER BY src) AS src, list(share ORDER BY src) AS share, CAST(sum(share) AS BIGINT) AS period FROM sh),
run AS (
  SELECT CAST(0 AS BIGINT) AS t, list_transform(share, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick, CAST(0 AS BIGINT) AS turn FROM s
  UNION ALL
  SELECT t, list_transform(done, lambda d, i: CASE WHEN i = p THEN d + 1 ELSE d END), p, done[p] FROM (
    SELECT run.t + 1 AS t, run.done, list_sort(list_transform(
      list_filter(range(1, len(s.src) + 1), lambda i: run.done[i] * s.period < s.share[i] * (run.t + 1) AND run.done[i] < s.share[i]),
      lambda i: {'due': ((run.done[i] + 1) * s.period + s.share[i] - 1) // s.share[i], 'i': i}))[1].i AS p
    FROM run, s WHERE run.t < s.period)),
plan AS (SELECT s.src[pick] AS src, s.share[pick] AS share, s.period, turn, t - 1 AS slot FROM run, s WHERE t > 0),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR) || ' ' || md5(coalesce(text, '')))) - 1 AS k FROM documents)
SELECT doc_id, source, k // 16 AS block, (k // 16 // share) * period + slot AS slot, ((k // 16 // share) * period + slot) * 16 + k % 16 AS mix_position
FROM r JOIN plan ON plan.src = r.source AND plan.turn = (k // 16) % share
"""


def oracle_sql():
    return {"op1_lm_score": OP1, "op2_exact_dedup": OP2, "op3_substring_dedup": OP3, "op6_license_scan": _op6(), "op10_mix_sources": OP10}
