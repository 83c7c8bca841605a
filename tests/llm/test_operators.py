"""Each operator against brute force, and on odd rows: nulls, empty and very long texts,
ties, repeated rows, empty tables, clashing column names."""

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quadrille.llm.exact_dedup import CountingQuotientFilter, exact_dedup, keep_one
from quadrille.llm.jaccard import ngram_jaccard
from quadrille.llm.language_id import identify_language, keep_identified, learn
from quadrille.llm.license_scan import LICENSES, license_scan
from quadrille.llm.lm_score import lm_score, ngram_counts
from quadrille.llm.merkle import Tree, aligned, edited, edits, fingerprint_with_next, likeness
from quadrille.llm.mixing import mix_sources, schedule
from quadrille.llm.pieces import Codec, Vocabulary, decode_pieces, encode_pieces
from quadrille.llm.relative_lz import substring_dedup
from quadrille.llm.suffix_dedup import suffix_dedup

SF = "/root/testdata/sf0.001"
#: Extra columns whose names the operators use themselves.
CLASH = ["block", "slot", "share", "n", "salt", "fp", "node", "kept", "bucket", "k"]


def words(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    base = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 7 else None) for i, t in enumerate(base)]
    n = 100
    for _ in range(40):
        a, b = rng.choice(base), rng.choice(base)
        rows.append((n, a[: rng.randrange(len(a))] + " " + b[rng.randrange(len(b)) :], "en", "s0"))
        n += 1
    rows += [(200, None, "en", "s1"), (201, "", "de", None), (202, " \n\t ", "en", "s2"), (203, "!!! 123", None, "s1"), (None, "no id at all", None, "s1")]
    rows += [(204, "wort " * 5000, "de", "s1"), (205, "a" * 6000, "en", "s1"), (206, "ab" * 500, "en", "s1"), (207, "é😀▁ x y  z\r\nq ", "en", "s1")]
    rows += [rows[3], rows[3], (210, base[3], "en", "s0"), (211, base[3], "en", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(7) for c in CLASH}).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def as_counter(rows):
    return Counter(map(tuple, rows))


def test_lm_score(odd, empty):
    docs = pairs(odd)
    counts, total = Counter(), 0
    for _, t in docs:
        w = words(t)
        total += len(w)
        counts.update(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))

    def score(t):
        w, s = words(t), 0.0
        for k in range(len(w)):
            fine = 0.0
            for n in range(min(3, k + 1), 0, -1):
                g = tuple(w[k - n + 1 : k + 1])
                if n == 1:
                    s += math.log(counts[g] / total) + fine
                elif counts[g]:
                    s += math.log(counts[g] / counts[g[:-1]]) + fine
                    break
                fine += math.log(0.4)
        return len(w), round(s, 6) if w else None

    want = Counter((i, *score(t)) for i, t in docs)
    tables = Counter((r.n, r.total) for r in ngram_counts(odd, block_bytes=20_000).collect())
    assert tables == Counter((len(g), c) for g, c in counts.items()) + Counter([(0, total)])
    got = lm_score(odd, block_bytes=20_000).select("doc_id", "n_words", F.round("log_score", 6)).collect()
    assert as_counter(got) == want
    assert lm_score(empty).count() == 0


@pytest.mark.parametrize("order", [1, 2, 4])
def test_lm_score_orders(odd, order):
    rows = lm_score(odd, order=order, block_bytes=50_000).collect()
    assert len(rows) == odd.count() and all((r.log_score is None) == (r.n_words == 0) for r in rows)


def test_counting_quotient_filters_merge_without_loss():
    import numpy as np

    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 50, 80).astype(np.uint64) * np.uint64(0x0123456789ABCDEF) for _ in range(4)]
    merged = CountingQuotientFilter.merged([CountingQuotientFilter.of(p, 8) for p in parts])
    want = Counter(x for p in parts for x in p.tolist())
    assert dict(zip(merged.fingerprints().tolist(), merged.counts.tolist(), strict=True)) == dict(want)
    part = merged.cut(16, 32)
    again = CountingQuotientFilter.from_bytes(8, 16, *part.to_bytes())
    assert again.fingerprints().tolist() == part.fingerprints().tolist() == sorted(x for x in want if 16 <= x >> 56 < 32)


def test_exact_dedup(odd, empty):
    groups = defaultdict(list)
    for i, t in pairs(odd):
        groups[t or ""].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        for i in ids:
            want[i, keep, len(ids), sha] += 1
    rows = exact_dedup(odd).collect()
    assert as_counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert Counter(r.text_sha256 for r in rows if r.kept) == dict.fromkeys((hashlib.sha256(t.encode()).hexdigest() for t in groups), 1)
    assert exact_dedup(empty).count() == 0
    left = keep_one(odd)
    assert left.columns == odd.columns and sorted(t or "" for _, t in pairs(left)) == sorted(groups)
    assert keep_one(empty).count() == 0


def test_exact_dedup_of_rows_without_ids(spark):
    rows = [(None, "same text")] * 3000 + [(7, "same text")] * 1500 + [(i, "same text") for i in range(2000, 4500)] + [(None, None), (None, ""), (1, "other")]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), n_ranges=1 << 12).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert [(r.doc_id, r.group_size) for r in got if r.kept and r.group_size > 2] == [(4499, 7000)]
    assert sum(r.kept for r in got) == 3 and {r.keep_id for r in got if r.group_size == 2} == {None}


def test_substring_dedup(odd, empty):
    docs = sorted(pairs(odd), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest()))
    seen, want = set(), Counter()
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            if g in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(g)
        want[i, len(w), sum(gone), b" ".join(x for x, y in zip(w, gone, strict=True) if not y).decode()] += 1
    for block, stretch in ((5_000, None), (40_000, 500)):
        got = substring_dedup(odd, block_bytes=block, stretch_bytes=stretch).select("doc_id", "n_words", "n_removed", "kept_text").collect()
        assert as_counter(got) == want
    assert substring_dedup(empty).count() == 0


def test_licenses_however_wrapped(spark):
    import textwrap

    import duckdb

    from quadrille.llm.queries import _op6

    rows = []
    for name, body in [x for x in LICENSES if "\n\n" not in x[1]]:
        for width in (30, 47, 61, 80):
            text = textwrap.fill(" ".join(body.split()), width)
            rows.append((len(rows), "Copyright (c) 1999-2020, Some Body\nAll rights reserved.\n\n" + text, name))
            rows.append((len(rows), "/*\n * Copyright Some Body\n * (c) 2001 Other\n" + textwrap.indent(text, " * ") + "\n */", name))
    rows.append((len(rows), "Copyright notice without a licence", None))
    df = spark.createDataFrame(rows, "doc_id long, text string, want string")
    got = {r.doc_id: (r.digest, r.license_id) for r in license_scan(df).collect()}
    # a line of prose that begins with the words of a copyright line can't be told from one
    wrong = [i for i, _, want in rows if got[i][1] != want]
    assert not wrong, [(rows[i][2], rows[i][1][:80]) for i in wrong[:3]]
    con = duckdb.connect()
    documents = df.select("doc_id", "text").toPandas()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT * FROM documents")
    assert {i: (d, n) for i, d, n in con.execute(_op6()).fetchall()} == got


def blocks_of(docs, block_bytes):
    """The words of each reference block, as the operator deals and orders them."""
    import pyarrow as pa

    from quadrille.llm.exchange import block_count, in_order, ranged

    src = docs.select("doc_id", "text")
    rows = ranged(src, block_count(src, block_bytes)[0]).toArrow()
    found = {}
    for b in set(rows["block"].to_pylist()):
        own = in_order(rows.filter(pa.compute.equal(rows["block"], b)))
        found[b] = [w for t in own["text"].to_pylist() for w in words(t)]
    return found


def test_factors_occur_in_their_reference(odd):
    rows = substring_dedup(odd, block_bytes=5_000).collect()
    blocks, texts = blocks_of(odd, 5_000), defaultdict(set)
    assert len(blocks) > 5
    for i, t in pairs(odd):
        texts[i].add(tuple(words(t)))
    for r in rows:
        assert bool(r.factors) == (r.n_removed > 0)
        for f in r.factors:
            assert f.length >= 20 and f.start + f.length <= r.n_words
            there = tuple(blocks[f.reference][f.position : f.position + f.length])
            assert any(t[f.start : f.start + f.length] == there for t in texts[r.doc_id])
    assert len({f.reference for r in rows for f in r.factors}) > 3


def test_factors_are_greedy_and_boundaries_looked_up(spark):
    w = [f"w{i}" for i in range(60)]
    first = [(1, " ".join(w[:30]) + " x"), (2, "y " + " ".join(w[11:60]))]
    rows = first + [(i, " ".join(f"f{i}_{j}" for j in range(50))) for i in range(3, 40)] + [(99, " ".join(w))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    (got,) = [r for r in substring_dedup(docs, block_bytes=1000).collect() if r.doc_id == 99]
    assert got.n_removed == 60 and got.kept_text == ""
    assert [(f.start, f.length, f.position) for f in got.factors if f.length > 20] == [(0, 30, 0), (30, 30, 51)]
    assert sorted(f.start for f in got.factors if f.length == 20) == list(range(11, 30))


def test_substring_dedup_splits_rows_without_ids(spark):
    base = [" ".join(f"{i}a{j}" for j in range(60)) for i in range(30)]
    rows = [(None, t) for t in base] + [(None, t + " more") for t in base] + [(5, base[0]), (6, base[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    blocks = blocks_of(docs, 4000)
    assert sum(len(b) > 0 for b in blocks.values()) > 3  # null ids lie in several blocks
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).digest()))
    seen, want = set(), Counter()
    for i, t in order:
        w, gone = words(t), set()
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            gone |= set(range(k, k + 20)) if g in seen else set()
            seen.add(g)
        want[i, len(w), len(gone)] += 1
    got = substring_dedup(docs, block_bytes=4000).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed) for r in got) == want


def test_suffix_dedup(odd, empty):
    docs, width = pairs(odd), 400
    counts = Counter()
    for _, t in docs:
        b = (t or "").encode()
        counts.update(b[k : k + width] for k in range(len(b) - width + 1))
    want = Counter()
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if counts[b[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        spans = sum(1 for j, x in enumerate(gone) if x and (not j or not gone[j - 1]))
        want[i, len(b), sum(gone), spans, bytes(x for x, y in zip(b, gone, strict=True) if not y)] += 1
    for block, batch, hot in ((20_000, 4 << 20, 4096), (60_000, 2_000, 4096), (30_000, 5_000, 2)):
        got = suffix_dedup(odd, block_bytes=block, batch_bytes=batch, hot_contexts=hot).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    assert suffix_dedup(empty).count() == 0


def test_suffix_dedup_of_long_runs_and_pieces(spark, monkeypatch):
    import time

    import numpy as np

    import quadrille.llm.suffix_dedup as S
    from quadrille.llm.textops import utf8_column

    rng = random.Random(4)
    noise = lambda n: "".join(rng.choices("abcdefgh \n", k=n))
    shared = noise(900)
    texts = ["-" * 3000, "x" + "-" * 401 + "y", noise(300) + "-" * 400 + noise(300), "-" * 5000 + "=" * 700, shared + "-" * 2000 + shared, noise(50) + shared[:500] + "=" * 399, "ab" * 900]
    counts = Counter(t[k : k + 400] for t in texts for k in range(len(t) - 399))

    def check():
        got = {r.doc_id: bytes(r.kept) for r in S.suffix_dedup(docs).collect()}
        for i, t in enumerate(texts):
            gone = [False] * len(t)
            for k in range(len(t) - 399):
                if counts[t[k : k + 400]] > 1:
                    gone[k : k + 400] = [True] * 400
            assert got[i] == "".join(c for c, g in zip(t, gone, strict=True) if not g).encode(), i

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check()
    data, offsets = utf8_column(docs.toArrow()["text"])
    whole = S.segments(data, offsets, 400, 64)
    monkeypatch.setattr(S, "byte_chunks", lambda offsets, most: ((i, i + 1) for i in range(len(offsets) - 1)))
    monkeypatch.setattr(S, "_PIECE", 1000)
    parts = S.segments(data, offsets, 400, 64)

    def windows(found):
        return Counter((int(k), int(f) + i) for k, f, n in zip(*found[:3], strict=True) for i in range(n))

    assert windows(parts) == windows(whole) and len(parts[0]) > len(whole[0])
    began = time.perf_counter()
    assert S._sort_batch([b"-" * 2_000_000], np.array([2_000_000 - 399]), 400).all()
    assert time.perf_counter() - began < 5


def brute_ids(vocabulary, text):
    """Ids of the best-scoring segmentation of a blank-led text; of equal scores at a
    position, the one whose last piece is longest."""
    score = {p.replace("▁", " "): (s, i) for i, (p, s) in enumerate(zip(vocabulary.pieces, vocabulary.scores, strict=True)) if i not in vocabulary.special}
    lost, most = min(s for s, _ in score.values()) - 10, max(map(len, score))
    best, back = [0.0] + [-math.inf] * len(text), [None] * (len(text) + 1)
    for e in range(1, len(text) + 1):
        for a in range(max(0, e - most), e):
            if text[a:e] in score and best[a] + score[text[a:e]][0] > best[e]:
                best[e], back[e] = best[a] + score[text[a:e]][0], (a, [score[text[a:e]][1]])
        if text[e - 1] not in score and best[e - 1] + lost > best[e]:
            best[e], back[e] = best[e - 1] + lost, (e - 1, [vocabulary.bytes_at[b] for b in text[e - 1].encode()])
    ids, e = [], len(text)
    while e:
        e, own = back[e]
        ids[:0] = own
    return ids


def test_pieces(odd, empty):
    vocabulary = Vocabulary.load()
    codec = Codec(vocabulary)
    for text in ["hello world  again", "é😀▁", "x\ny", " ", "naïve Straße 12.5", "zz" * 20]:
        assert codec.encode(text).tolist() == brute_ids(vocabulary, " " + text) and codec.decode(codec.encode(text)) == text
    encoded = encode_pieces(odd, carry=("lang",))
    texts = [(r.doc_id, r.text, r.token_ids) for r in encode_pieces(odd, carry=("text",)).collect()]
    for _, t, ids in texts:
        if t is None or len(t) < 4000:
            assert ids == (None if t is None else brute_ids(vocabulary, " " + t) if t else [])
    back = decode_pieces(encoded, carry=("lang", "n_tokens"))
    assert as_counter(pairs(back)) == as_counter(pairs(odd))
    assert {r.n_tokens for r in back.where("text is null").collect()} == {None}
    assert decode_pieces(encode_pieces(empty)).count() == 0


def test_pieces_with_ties():
    """Pieces of one score: the longest last piece wins at each position."""
    pieces = ["a", "b", "ab", "ba", "aba", " ", " a", *(f"<0x{i:02X}>" for i in range(256))]
    vocabulary = Vocabulary(pieces, [-1.0] * 7 + [0.0] * 256, list(range(7, 263)), frozenset(range(7, 263)))
    codec, rng = Codec(vocabulary), random.Random(1)
    for _ in range(300):
        text = "".join(rng.choices("ab c", k=rng.randrange(1, 15)))
        assert codec.encode(text).tolist() == brute_ids(vocabulary, " " + text) and codec.decode(codec.encode(text)) == text


def test_license_scan(spark, odd, empty):
    rows = [(i, f"Copyright (c) 20{i:02d} Someone\n\n" + body.upper().replace(" ", "  ").replace(",", ";"), name) for i, (name, body) in enumerate(LICENSES)]
    rows.append((99, LICENSES[0][1] + " and more", None))
    rows.append((98, LICENSES[-1][1].replace("license", "licence").replace("License", "Licence"), LICENSES[-1][0]))
    df = spark.createDataFrame(rows, "doc_id long, text string, want string")
    got = {r.doc_id: r.license_id for r in license_scan(df).collect()}
    assert got == {i: want for i, _, want in rows}
    assert license_scan(odd.withColumns({"digest": F.lit(1), "license_id": F.lit(2)})).count() == odd.count()
    assert license_scan(empty).count() == 0
    assert "Python" not in license_scan(odd)._jdf.queryExecution().toString()


def test_ngram_jaccard(odd, empty):
    docs = pairs(odd)
    texts = sorted({t or "" for _, t in docs})
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(words, texts)]
    near = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if grams[a] and grams[b] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]) - 1e-9}
    copies, least = Counter(t or "" for _, t in docs), {}
    for i, t in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near:
        root[find(a)] = find(b)
    classes = defaultdict(list)
    for x, t in enumerate(texts):
        if t in least:
            classes[find(x)].append(least[t])
    want = Counter()
    for i, t in docs:
        x = texts.index(t or "")
        links = copies[t or ""] - 1 + sum(copies[texts[b if a == x else a]] for a, b in near if x in (a, b))
        want[i, min(classes[find(x)]) if classes[find(x)] else None, links, copies[t or ""]] += 1
    got = ngram_jaccard(odd).collect()
    assert Counter((r.doc_id, r.class_id if r.class_id >= 0 else None, r.n_links, r.n_copies) for r in got) == want
    assert ngram_jaccard(empty).count() == 0


def test_jaccard_clusters_of_many_chunks(spark, monkeypatch):
    import quadrille.llm.jaccard as J

    monkeypatch.setattr(J, "CHUNK_NODES", 7)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[:50] + [f"x{i}"] + base[50:])) for i in range(40)]
    got = J.ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 39)}


def test_ngram_jaccard_chunks_of_one_side(spark, monkeypatch):
    import quadrille.llm.jaccard as jaccard

    rows = []
    for c in range(12):
        rng = random.Random(c)
        text = " ".join(str(rng.randrange(10**6)) for _ in range(400))
        rows += [(10 * c + k, f"{text} {k}") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "CHUNK_GRAMS", 400)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_jaccard(docs).collect()}
    assert got == {i: (i // 10 * 10, 2) for i, _ in rows}


def test_language_id(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify_language(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 150 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and sum(r.rejected for r in got) < 0.02 * len(got)
    model = learn(docs)
    noise = spark.createDataFrame([(1, "qxzj vkkw zzqx jjxv " * 20), (2, None), (3, "12 34"), (4, "the of and to in that is was for with " * 5)], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    rows = {r.doc_id: r for r in identify_language(noise, model).collect()}
    assert rows[1].rejected and rows[2].lang_pred == rows[3].lang_pred == "und" and rows[2].score == 0 and rows[4].lang_pred == "en"
    assert [r.doc_id for r in keep_identified(noise, model).collect()] == [4]
    assert identify_language(odd).count() == odd.count() and keep_identified(odd).columns == odd.columns
    assert identify_language(empty).count() == 0 and {r.lang_pred for r in identify_language(noise).collect()} == {"und"}


class BruteKneserNey:
    """Interpolated Kneser-Ney over characters, by definition."""

    def __init__(self, texts, order=4, discount=0.75):
        self.d, self.order = discount, order
        texts = [self.plain(t) for t in texts]
        seen = [Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1)) for n in range(order + 1)]
        self.count = [None] * (order + 1)
        self.count[order] = seen[order]
        for n in range(1, order):
            before = Counter(g[1:] for g in seen[n + 1])
            self.count[n] = {g: before.get(g, 1) for g in seen[n]}
        self.mass, self.kinds = [Counter() for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
        for n in range(1, order + 1):
            for g, c in self.count[n].items():
                self.mass[n][g[:-1]] += c
                self.kinds[n][g[:-1]] += 1

    @staticmethod
    def plain(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        return " " + "".join(w + " " for w in words)

    def p(self, gram):
        n = len(gram)
        mass, kinds = self.mass[n][gram[:-1]], self.kinds[n][gram[:-1]]
        if not mass:
            return self.p(gram[1:])
        rest = self.d * kinds / mass
        own = max(self.count[n].get(gram, 0) - self.d, 0) / mass
        return own + (rest * self.p(gram[1:]) if n > 1 else rest / (kinds + 1))

    def log(self, text):
        t = self.plain(text)
        return sum(math.log(self.p(t[max(0, i - self.order + 1) : i + 1])) for i in range(1, len(t))), len(t) - 1


def test_language_models_are_kneser_ney(spark):
    import numpy as np

    from quadrille.llm.language_id import train

    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.lang and len(r.text) < 1500]
    learnt, rest = rows[:60], [t for _, t in rows[60:]] + ["", "...", "ß", "zzz qqq \u4e2d\u6587", "ends in a letter", "ends in a mark."]
    model = train([(lang, t, False) for lang, t in learnt])
    brute = [BruteKneserNey([t for lang, t in learnt if lang == k]) for k in model.languages]
    total, chars, _ = model.log_likelihood(rest)
    for t, row, n in zip(rest, total, chars, strict=True):
        want = [b.log(t) for b in brute]
        assert {m for _, m in want} == {n} and row == pytest.approx([x for x, _ in want], rel=1e-4, abs=1e-3)
        (alone,), _, _ = model.log_likelihood([t])
        assert alone == pytest.approx(row, rel=1e-6, abs=1e-4)  # whatever stands beside it
    lang = model.predict(rest, 8.0)[0]
    for k, t in zip(lang, rest, strict=True):
        scores = [b.log(t)[0] for b in brute]
        assert (k == -1) == (not any(map(str.isalpha, t))) and (k < 0 or scores[k] == pytest.approx(max(scores), rel=1e-4))
    symbols = [" ", *map(chr, model.alphabet[model.alphabet != 32])]
    for b in brute:  # each context's probabilities sum to one, with one unknown symbol
        for context in ("", "e", "en", " th", "zzq"):
            known = {s for s in symbols if s in b.count[1]}
            assert sum(b.p(context + s) for s in known) + b.p(context + "\x00") == pytest.approx(1)
    assert np.isfinite(total).all()


def true_likeness_bounds(a, b, near):
    """At most 1 for equal texts alone; at least what the common head gives, but for the
    leaves around the edit; at most what the characters in common allow."""
    if a == b:
        return near == 1
    if not a or not b:
        return near == 0
    head = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    common = sum((Counter(a) & Counter(b)).values())
    least = 2 * max(0, head - 64) / (len(a) + len(b))
    return least - 1e-9 <= near <= 2 * common / (len(a) + len(b)) + 1e-9 and near < 1


def test_fingerprints(odd, empty):
    rows = [*pairs(odd), *((None, f"no id {i}. " * i) for i in range(60))]
    docs = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest()), reverse=True)
    want, near = Counter(), defaultdict(list)
    for j, (i, t) in enumerate(docs):
        after = docs[(j + 1) % len(docs)][1] or ""
        new = edited(t or "", after)
        want[i, len(t or ""), hashlib.sha256(new.encode()).hexdigest(), Tree(t or "").root, Tree(new).root] += 1
        near[i, hashlib.sha256(new.encode()).hexdigest()].append((t or "", new, after))
    frame = odd.select("doc_id", "text").union(odd.sparkSession.createDataFrame(rows[-60:], "doc_id long, text string"))
    for size in (5_000, 10**9):
        got = fingerprint_with_next(frame, block_bytes=size).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got) == want
        for r in got:
            t, new, after = near[r.doc_id, r.edited_sha256][0]
            assert true_likeness_bounds(t, new, r.near_edited) and true_likeness_bounds(t, after, r.near_next)
            spans = [(x.start, x.start + x.length) for x in r.edits]
            assert spans == sorted(spans) and all(e <= s for (_, e), (s, _) in zip(spans, spans[1:], strict=False))
            # what lies outside the edits is in the edited text, in order
            at = 0
            for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(t)], strict=True):
                assert (at := new.find(t[a:b], at)) >= 0
                at += b - a
    assert fingerprint_with_next(empty).count() == 0
    assert fingerprint_with_next(odd.limit(1)).count() == 1


def test_whole_licenses_are_known(spark):
    whole = dict(LICENSES)
    rows = [(name, "Copyright 2020 Someone\n" + whole[name].upper()) for name in ("Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "Unlicense", "CC0-1.0")]
    assert all(len(body) > 1000 for _, body in rows)
    rows.append(("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."))
    got = license_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert len(got) == len(rows) and all(r.license_id == r.doc_id for r in got)


def test_trees():
    a = "One. Two here.\nThree!\n\nSecond section. " + "long words without an end " * 100
    b = a.replace("Two here", "Two there")
    assert Tree(a).root == Tree(a).root != Tree(b).root
    assert likeness(Tree(a), Tree(a)) == 1 and 0.9 < likeness(Tree(a), Tree(b)) < 1 and likeness(Tree(a), Tree("")) == 0 and likeness(Tree(""), Tree("")) == 1
    (s, e, t, f), *more = edits(Tree(a), Tree(b))
    assert a[:s] + b[t:f] + a[e:] == b and e - s <= 2 and f - t <= 2 and not more


def test_trees_in_order():
    one, two = "First paragraph. It is here.\n", "Second one. It is there.\n"
    a, b = Tree(one * 3 + two), Tree(two + one * 3)
    assert a.root != b.root and 0.5 < likeness(a, b) < 1
    assert likeness(Tree("abcdefghijklmnop"), Tree("abcdefghijkzzzzz")) == 2 * 11 / 32


def test_alignment_is_a_common_rising_run():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([bytes([rng.randrange(6)]) for _ in range(rng.randrange(14))] for _ in range(2))
        met = aligned(a, b)
        assert all(a[i] == b[j] for i, j in met) and all(x < y and v < w for (x, v), (y, w) in zip(met, met[1:], strict=False))
    a = [bytes([x]) for x in rng.sample(range(200), 100)]
    b = rng.sample(a, 100)
    assert len(aligned(a, b)) == max_rising([a.index(x) for x in b])


def max_rising(places):
    best = []
    for i, x in enumerate(places):
        best.append(1 + max((best[j] for j in range(i) if places[j] < x), default=0))
    return max(best)


def test_near_edited_of_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = fingerprint_with_next(docs).collect()
    assert len(rows) == docs.count() and min(r.near_edited for r in rows if r.n_chars > 2) > 0.3


@pytest.mark.parametrize("text", ["abc " * 1500, "x" * 6000, "".join(map(str, range(1500))), "?" * 6000], ids=["one word", "one letter", "no blank", "marks"])
def test_trees_of_text_without_sentences(text):
    want = 2 * (len(text) - len(text) // 3) / (2 * len(text))
    assert abs(likeness(Tree(text), Tree(edited(text, "Other text 12. " * 500))) - want) < 0.03
    middle = text[:2000] + "##" + text[2000:4000] + "%" + text[4000:]
    assert likeness(Tree(text), Tree(middle)) > 0.9  # more than the ends alone
    assert max(n for s in Tree(text).sections for p in s[2] for _, n in p[2]) <= 64


def test_trees_either_side_of_any_length():
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(157))[:1099]
    middle = text[:300] + text[600:]  # 799 characters
    parts = text[:250] + "#" + text[300:600] + "#" + text[650:]
    assert abs(likeness(Tree(text), Tree(edited(text, "short"))) - 2 * 733 / (1099 + 738)) < 0.03
    assert likeness(Tree(text), Tree(middle)) > 0.8
    kept = 250 + 300 + 319  # each of three edits may cost two leaves
    assert likeness(Tree(text), Tree(parts[:-130])) > 2 * (kept - 3 * 2 * 64) / (1099 + 871)


def test_mixing(spark, odd, empty):
    rows = mix_sources(odd, weights={"s0": 3, "s1": 2}, block_rows=4).collect()
    assert len(rows) == odd.count() and len({r.mix_position for r in rows}) == len(rows)
    for s in {r.source for r in rows}:
        sizes = Counter(r.block for r in rows if r.source == s)
        assert all(sizes[b] == 4 for b in sorted(sizes)[:-1])
    assert mix_sources(empty).count() == 0
    twice = [{(r.doc_id, r.source): r.mix_position for r in mix_sources(odd.repartition(n)).where("doc_id is not null and doc_id <> 3").collect()} for n in (3, 7)]
    assert twice[0] == twice[1]
    alone = mix_sources(odd.drop("text"), digits=1).collect()
    assert len({r.mix_position for r in alone}) == odd.count()
    assert "Python" not in mix_sources(odd)._jdf.queryExecution().toString()


@pytest.mark.parametrize("shares", [{"a": 1}, {"a": 50, "b": 30, "c": 19, "d": 1}, {"a": 1, "b": 1, "c": 7}, {f"s{i}": i + 1 for i in range(12)}])
def test_schedule_stays_within_a_block(spark, shares):
    rows = sorted(schedule(spark.createDataFrame(list(shares.items()), "src string, share int")).collect(), key=lambda r: r.slot)
    period = sum(shares.values())
    assert [r.slot for r in rows] == list(range(period))
    had = Counter()
    for t, r in enumerate(rows, 1):
        assert r.turn == had[r.src]
        had[r.src] += 1
        assert all(abs(had[s] - w * t / period) < 1 for s, w in shares.items())
    assert had == Counter(shares)
