"""Language identification by character language models (operator 8).

For each language an interpolated Kneser-Ney model over characters (lower case; every
run of other characters than letters is one blank) is learnt. The models share sorted
arrays of n-gram hashes, one for each order, whose rows hold every language's interpolated
log probability, or the weight of backing off from a context; a directory of the hashes'
high bits leads to the rows. A text's language is the one of least cross-entropy a
character, over the whole text.

score is a softmax of the log likelihoods, tempered so that it is calibrated on sample
documents kept out of the counts. ``rejected`` tells that the best cross-entropy is far
above what that language's calibration documents have (``reject_z`` deviations, with the
text's length taken into account): text in none of the learnt languages.

Learning takes a bounded sample: of each language the ``sample_docs`` rows first by a hash
of doc_id and text, without those over ``sample_chars`` characters; it is the only thing the
driver sees and bounds the model, which is broadcast. Prediction is map-only over all rows and
whole texts; it sees nothing but the text.

Defined cases: null text, or one without letters, is ``und`` with score 0 and rejected;
without labelled rows every text is; repeated rows get equal results.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.textops import U64, byte_chunks, give_back, mix

ORDER = 4
#: Letters of the sample that have a symbol of their own (the commonest; symbols have 16
#: bits). All others share the symbol of an unknown letter.
ALPHABET = 65_000
_CODES = 0x110000
#: Characters that are judged at a time, or one longer text.
CHUNK = 1 << 18
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(_CODES)), bool, _CODES)
    return _letters


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each led and closed by one blank, offsets (n + 1), and
    each text's letters."""
    lower = [t.lower() for t in texts]
    sizes = np.fromiter((len(t) + 2 for t in lower), np.int64, len(lower))
    codes = np.frombuffer((" " + "  ".join(lower) + " ").encode("utf-32-le", "replace"), np.uint32)
    # text i lies at [start_i, start_i + len_i), with a blank of its own before and after
    start = 1 + np.concatenate([[0], np.cumsum(sizes)])
    letter = letters()[codes]
    out = np.where(letter, codes, 32).astype(np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a blank is kept only after a letter
    lead = np.zeros(len(out), bool)
    lead[start[:-1] - 1] = True  # and before each text
    keep[start[:-1] - 1] = False
    place = np.flatnonzero(keep | lead)
    out = out[place]
    offsets = np.searchsorted(place, start[:-1] - 1, "left")
    return out, np.append(offsets, len(out)), np.add.reduceat(np.append(letter, False).astype(np.int64), start[:-1]) if len(texts) else np.zeros(0, np.int64)


def packed(symbols: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of 16-bit symbols within each text and the index of their last symbol."""
    code = symbols.astype(U64)
    gram = code
    for _ in range(n - 1):
        gram = gram[:-1] << U64(16) if len(gram) else gram
        gram = gram | code[len(code) - len(gram) :]
    ok = np.ones(len(gram), bool)
    for k in range(1, n):
        at = offsets[1:-1] - k
        ok[at[(at >= 0) & (at < len(ok))]] = False
    first = np.flatnonzero(ok)
    return gram[first], first + n - 1


@dataclass
class HashTable:
    """Sorted hashes with rows of values; a directory by the high bits."""

    keys: np.ndarray
    rows: np.ndarray
    bits: int
    start: np.ndarray
    longest: int

    @classmethod
    def of(cls, grams: np.ndarray, rows: np.ndarray) -> "HashTable":
        keys = mix(grams)
        order = np.argsort(keys)
        keys = keys[order]
        bits = max(4, int(len(keys)).bit_length() + 1)
        edge = np.arange((1 << bits) + 1, dtype=np.float64) * 2.0 ** (64 - bits)
        start = np.concatenate([np.searchsorted(keys, edge[:-1].astype(U64)), [len(keys)]]).astype(np.int32)
        return cls(np.append(keys, U64(0)), rows[order].astype(np.float32), bits, start, int(np.diff(start).max(initial=0)))

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Row of each n-gram, -1 where there is none."""
        h = mix(grams)
        slot = (h >> U64(64 - self.bits)).astype(np.int64)
        at, end = self.start[slot], self.start[slot + 1]
        found = np.where((at < end) & (self.keys[at] == h), at, -1)
        left = np.flatnonzero((found < 0) & (at + 1 < end))
        step = 1
        while len(left):
            p = at[left] + step
            hit = self.keys[p] == h[left]
            found[left[hit]] = p[hit]
            left = left[~hit & (p + 1 < end[left])]
            step += 1
        return found


@dataclass
class Model:
    languages: list[str]
    alphabet: np.ndarray  # sorted code points; symbol i + 1 is alphabet[i], 0 any other
    grams: list[HashTable]  # by order: log P(last symbol | those before)
    contexts: list[HashTable]  # by context length 1..: log weight of backing off
    floor: np.ndarray  # log P of an unknown symbol
    heat: float = 1.0
    mean: np.ndarray | None = None
    deviation: np.ndarray | None = None
    each: np.ndarray | None = None

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.alphabet, codes)
        known = self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == codes
        return np.where(known, at + 1, 0)

    def log_likelihood(self, texts: list[str], squares: bool = False):
        """Sum of log P for each text and language, characters scored, letters (and the
        sums of squares)."""
        codes, offsets, n_letters = normalise(texts)
        sym = self.symbols(codes)
        score = np.zeros((len(sym), len(self.languages)), np.float32)
        score[:] = self.floor
        todo = np.arange(len(sym))
        packs = [packed(sym, offsets, n) for n in range(1, ORDER + 1)]
        weight = np.zeros_like(score)
        open_ = np.ones(len(sym), bool)
        for n in range(ORDER, 0, -1):
            gram, last = packs[n - 1]
            live = open_[last]
            gram, last = gram[live], last[live]
            row = self.grams[n - 1].find(gram)
            hit = row >= 0
            score[last[hit]] = self.grams[n - 1].rows[row[hit]] + weight[last[hit]]
            open_[last[hit]] = False
            last, gram = last[~hit], gram[~hit]
            if n > 1 and len(last):
                row = self.contexts[n - 2].find(gram >> U64(16))
                hit = row >= 0
                weight[last[hit]] += self.contexts[n - 2].rows[row[hit]]
        todo = np.flatnonzero(open_)
        score[todo] = self.floor + weight[todo]
        score[offsets[:-1]] = 0  # the leading blank is given
        total = np.add.reduceat(score.astype(np.float64), offsets[:-1], axis=0) if len(texts) else np.zeros((0, len(self.languages)))
        chars = np.diff(offsets) - 1
        if squares:
            return total, chars, n_letters, np.add.reduceat(score.astype(np.float64) ** 2, offsets[:-1], axis=0)
        return total, chars, n_letters

    def predict(self, texts: list[str], reject_z: float):
        """Language index (-1: und), score, rejected, cross-entropy in nats a character."""
        total, chars, n_letters = self.log_likelihood(texts)
        n = np.maximum(chars, 1)
        best = total.argmax(axis=1)
        top = total[np.arange(len(best)), best]
        posterior = 1 / np.exp((total - top[:, None]) * self.heat).sum(axis=1)
        mean = top / n
        far = mean < self.mean[best] - reject_z * np.sqrt(self.deviation[best] ** 2 + self.each[best] / n)
        none = n_letters == 0
        return np.where(none, -1, best), np.where(none, 0.0, posterior), far | none, np.where(none, 0.0, -mean)


def _counts(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(grams, return_counts=True)


def _kneser_ney(sym: np.ndarray, offsets: np.ndarray, discount: float = 0.75):
    """One language's n-grams with probabilities and contexts with weights, by order."""
    grams, contexts = [], []
    top = [_counts(packed(sym, offsets, n)[0]) for n in range(1, ORDER + 1)]
    lower = np.array([], U64), np.array([])
    for n in range(1, ORDER + 1):
        keys, count = top[n - 1]
        if n < ORDER:  # continuation counts: distinct symbols before
            follow = top[n][0] & U64((1 << (16 * n)) - 1)
            more, cont = _counts(follow)
            count = np.ones(len(keys), np.int64)  # n-grams that only begin texts count once
            count[np.searchsorted(keys, more)] = cont
        context = keys >> U64(16)
        heads, inverse = np.unique(context, return_inverse=True)
        mass, kinds = np.bincount(inverse, weights=count), np.bincount(inverse)
        back = discount * kinds / mass
        p = np.maximum(count - discount, 0) / mass[inverse]
        if n == 1:
            unknown = back[0] / (len(keys) + 1)
            p = p + unknown
        else:
            suffix = keys & U64((1 << (16 * (n - 1))) - 1)
            p = p + back[inverse] * lower[1][np.searchsorted(lower[0], suffix)]
            contexts.append((heads, np.log(back)))
        grams.append((keys, p))
        lower = keys, p
    return grams, contexts, unknown


def _find(have: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted array, and whether it is there."""
    at = np.searchsorted(have, keys)
    inside = at < len(have)
    inside[inside] = have[at[inside]] == keys[inside]
    return at, inside


def _log_p(lang, n: int, keys: np.ndarray) -> np.ndarray:
    """log P of any n-grams under one language's model."""
    grams, contexts, unknown = lang
    if n == 0:
        return np.full(len(keys), np.log(unknown))
    have, p = grams[n - 1]
    at, hit = _find(have, keys)
    out = np.empty(len(keys))
    out[hit] = np.log(p[at[hit]])
    miss = keys[~hit]
    if len(miss):
        rest = _log_p(lang, n - 1, miss & U64((1 << (16 * (n - 1))) - 1))
        if n > 1:
            heads, back = contexts[n - 2]
            at_c, known = _find(heads, miss >> U64(16))
            rest[known] += back[at_c[known]]
        out[~hit] = rest
    return out


def train(rows: list[tuple[str, str, bool]]) -> Model | None:
    """rows: language, text, whether the row is kept for calibration. Languages without a
    letter in their rows are not learnt."""
    rows = [r for r in rows if any(map(str.isalpha, r[1]))]
    languages = sorted({lang for lang, _, _ in rows})
    if not languages:
        return None
    learn = {k: [t for lang, t, held in rows if lang == k and not held] or [t for lang, t, _ in rows if lang == k] for k in languages}
    prepared = {k: normalise(v)[:2] for k, v in learn.items()}
    seen, n = np.unique(np.concatenate([c for c, _ in prepared.values()]), return_counts=True)
    seen = np.sort(seen[np.argsort(-n, kind="stable")[:ALPHABET]])
    model = Model(languages, seen, [], [], np.zeros(len(languages)))
    langs = [_kneser_ney(model.symbols(c), o) for c, o in prepared.values()]
    for n in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([g[n - 1][0] for g, _, _ in langs]))
        model.grams.append(HashTable.of(keys, np.stack([_log_p(x, n, keys) for x in langs], 1)))
    for n in range(1, ORDER):
        keys = np.unique(np.concatenate([c[n - 1][0] for _, c, _ in langs]))
        rows_ = np.zeros((len(keys), len(langs)))
        for j, (_, c, _) in enumerate(langs):
            rows_[np.searchsorted(keys, c[n - 1][0]), j] = c[n - 1][1]
        model.contexts.append(HashTable.of(keys, rows_))
    model.floor = np.array([np.log(u) for _, _, u in langs], np.float32)
    _calibrate(model, [r for r in rows if r[2]] or rows)
    return model


def _calibrate(model: Model, rows: list[tuple[str, str, bool]]) -> None:
    total, chars, n_letters, squares = model.log_likelihood([t for _, t, _ in rows], squares=True)
    truth = np.array([model.languages.index(k) for k, _, _ in rows])
    use = n_letters > 0
    total, chars, squares, truth = total[use], np.maximum(chars[use], 1), squares[use], truth[use]
    grid = 2.0 ** np.arange(-8, 1)
    loss = [np.mean(np.log(np.exp((total - total.max(1, keepdims=True)) * h).sum(1)) - (total[np.arange(len(truth)), truth] - total.max(1)) * h) if len(truth) else 0 for h in grid]
    model.heat = float(grid[int(np.argmin(loss))])
    k = len(model.languages)
    model.mean, model.deviation, model.each = np.full(k, -3.0), np.full(k, 0.3), np.full(k, 6.0)
    for j in range(k):
        own = truth == j
        if own.sum() >= 5:
            mean = total[own, j] / chars[own]
            centre = np.median(mean)
            model.mean[j] = centre
            model.deviation[j] = max(0.1, 1.4826 * np.median(np.abs(mean - centre)))
            model.each[j] = np.median(squares[own, j] / chars[own] - mean**2)


def learn(docs: DataFrame, sample_docs: int = 500, sample_chars: int = 20_000) -> Model | None:
    """The model of the labelled rows (non-null lang) outside the held-out fifth. Rows that
    repeat doc_id, lang and text count once."""
    key = F.xxhash64("doc_id", "lang", "text")
    labelled = docs.where("lang is not null and text is not null").where(~held_out())
    keys = labelled.select("lang", key.alias("h"))
    # first within 64 parts of a language, so that no task sees all its rows
    part = F.dense_rank().over(Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = keys.withColumn("p", part).where(F.col("p") <= sample_docs).select("lang", "h").distinct().withColumn("r", rank).where(F.col("r") <= sample_docs).select("h", (F.pmod("h", F.lit(6)) == 0).alias("calibrates"))
    texts = labelled.where(F.length("text") <= sample_chars).select("lang", "text", key.alias("h"))
    rows = texts.join(F.broadcast(chosen), "h").dropDuplicates(["h"]).select("lang", "text", "calibrates", "h").collect()
    return train([(r[0], r[1], r[2]) for r in sorted(rows, key=lambda r: (r[0], r[3]))])


def held_out():
    """Rows never learnt from: crc32 of the id's decimal text divides by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def identify_language(docs: DataFrame, model: Model | None = None, reject_z: float = 8.0) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, rejected,
    cross_entropy (nats a character, 0 without letters). The model is learnt from
    ``docs`` where none is given."""
    model = model or learn(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sizes = np.cumsum([0, *(len(t or "") for t in texts)])
            for a, b in byte_chunks(sizes, CHUNK):
                part = [t or "" for t in texts[a:b]]
                if model is None:
                    lang, score, rejected, ce = [-1] * len(part), np.zeros(len(part)), np.ones(len(part), bool), np.zeros(len(part))
                else:
                    lang, score, rejected, ce = model.predict(part, reject_z)
                names = [model.languages[k] if k >= 0 else "und" for k in lang] if model else ["und"] * len(part)
                piece = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(names), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()), pa.array(ce, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score", "rejected", "cross_entropy"])
        give_back()

    src = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return src.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean, cross_entropy double")


def keep_identified(docs: DataFrame, model: Model | None = None, reject_z: float = 8.0) -> DataFrame:
    """The rows of ``docs`` with all their columns but those that are rejected; without
    labelled rows nothing can be judged and all rows stay."""
    model = model or learn(docs)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            sizes = np.cumsum([0, *(len(t or "") for t in texts)])
            for a, b in byte_chunks(sizes, CHUNK):
                rejected = shared.value.predict([t or "" for t in texts[a:b]], reject_z)[2]
                yield batch.slice(a, b - a).filter(pa.array(~rejected))
        give_back()

    return docs.mapInArrow(run, docs.schema)
