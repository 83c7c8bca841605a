"""The pipeline's stages on a small table, each with what it must keep."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quadrille.llm import stages
from quadrille.llm.components import components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        seen[name] = now = spark.createDataFrame(now.collect(), now.schema)
        if name != "sentencepiece":
            assert now.columns == docs.columns
    exact = [r.text for r in seen["exact_dedup"].collect()]
    assert len(exact) == len(set(exact)) == len({r.text for r in seen["language_id"].collect()})
    assert seen["language_id"].count() >= 0.98 * len(before)
    assert seen["mix_sources"].count() == seen["ngram_jaccard"].count() <= len(exact)
    last = {r.doc_id: r.text for r in seen["sentencepiece"].collect()}
    assert last == {i: before[i] for i in last} and len(last) == seen["mix_sources"].count()


def test_run_has_all_that_the_stages_keep(spark):
    assert corpus_pipeline.run(spark, SF).where(F.size("token_ids") > 0).count() > 150


def test_near_copies_with_odd_ids(spark):
    def text(seed, end=""):
        rng = random.Random(seed)
        return " ".join(str(rng.randrange(10**6)) for _ in range(300)) + end

    rows = [(1, text(1)), (2, text(1, " a")), (None, text(1, " b"))]  # a null id in the class
    rows += [(5, text(2)), (6, text(2, " a")), (6, text(3))]  # an id given to a clean text too
    rows += [(-9, text(4)), (-8, text(4, " a")), (7, text(4, " b"))]
    rows += [(None, text(5)), (None, text(5, " a")), (None, text(6)), (8, None)]
    got = stages.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    seeds = [(r.text or "").split(" ")[0] for r in got]
    assert sorted(seeds) == sorted([*(text(k).split(" ")[0] for k in range(1, 7)), ""])
    assert set(map(tuple, got)) <= set(rows)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (20, 21), (5, 5)] + [(i, i + 1) for i in range(100, 140)] + [(1000, i) for i in range(1001, 1050)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in (1, 2, 3, 9)} == {1} and got[21] == 20 and {got[i] for i in range(100, 141)} == {100} and got[1049] == 1000 and 5 not in got


CLASH = ["block", "row", "__row", "fp", "node", "slot", "k", "n", "salt", "share", "bands", "ids"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank, short and long texts, copies, near copies,
    repeated rows and ids, and columns of the operators' own names."""
    rng = random.Random(8)
    base = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 5 else None) for i, t in enumerate(base)]
    long = " ".join(str(rng.randrange(500)) + rng.choice(["the", "and", "of"]) for _ in range(20_000))
    rows += [(100, None, "en", "s0"), (101, "", "en", None), (102, " \n", None, "s1"), (103, "one two", "en", "s0"), (104, "one two three", "de", "s1"), (105, long, "en", "s0")]
    rows += [(None, base[0], None, None), (None, base[1] + " end", "en", "s0"), (None, None, None, None), rows[2], rows[2], (3, base[4], "en", "s1"), (-5, base[5] + " more", "en", "s0"), (106, long + " x", "de", "s9")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(3) for c in CLASH}).repartition(4).cache()


def counted(df):
    return Counter(tuple(map(str, r)) for r in df.collect())


def near_classes(texts):
    """Texts by class of five-word Jaccard similarity of 0.8 and more, by brute force."""
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.encode().split() for t in texts)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if grams[a] and grams[b] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]) - 1e-9:
            root[find(a)] = find(b)
    return Counter(find(x) for x in range(len(texts)))


def test_each_stage_on_odd_rows(spark, odd):
    from quadrille.llm.language_id import identify_language

    rows = counted(odd)
    rejected = Counter(r.doc_id for r in identify_language(odd).collect() if r.rejected)
    kept = stages.language(spark, odd, SF)
    assert kept.columns == odd.columns and counted(kept) <= rows
    assert Counter(r.doc_id for r in odd.collect()) - Counter(r.doc_id for r in kept.collect()) == rejected and rejected[100] == rejected[101] == rejected[102] == 1

    one = stages.exact(spark, odd, SF)
    assert one.columns == odd.columns and counted(one) <= rows
    best = {}
    for r in odd.collect():
        t = r.text or ""
        best[t] = max(best.get(t, -(1 << 63)), -(1 << 63) if r.doc_id is None else r.doc_id)
    assert Counter((r.text or "", -(1 << 63) if r.doc_id is None else r.doc_id) for r in one.collect()) == Counter(best.items())

    apart = stages.near(spark, one, SF)
    assert apart.columns == odd.columns and counted(apart) <= rows
    left = [r.text or "" for r in apart.collect()]
    assert len(left) == len(near_classes(sorted(best))) and max(near_classes(left).values()) == 1

    mixed = stages.mixture(spark, odd, SF)
    assert mixed.columns == odd.columns and counted(mixed) == rows

    last = stages.encode(spark, odd, SF).collect()
    assert Counter((r.doc_id, r.source, r.text) for r in last) == Counter((r.doc_id, r.source, r.text) for r in odd.collect())
    assert all((r.token_ids is None) == (r.text is None) and (r.text is None or len(r.token_ids) == r.n_tokens) for r in last)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, odd, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, odd.where("false"), SF).count() == 0


def test_mixture_is_read_in_its_order(spark, tmp_path):
    from quadrille.llm.mixing import mix_sources

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = [r.doc_id for r in mix_sources(docs).orderBy("mix_position").collect()]
    assert [r.doc_id for r in stages.mixture(spark, docs, SF).collect()] == want
