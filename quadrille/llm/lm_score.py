"""LM scoring: stupid backoff against n-gram counts of the whole corpus (operator 1).

Counts of all n-grams up to ``order`` are partitioned by hash. Each block of
documents is exploded into its n-grams, combined to distinct ones with counts, and
joined to the count tables through the hash exchange: a range of the hash space sums
the counts of all blocks and answers each block. The scores of a document's words
are then summed per document.

    S(w | h) = c(hw) / c(h)           where hw is seen (c >= min_count)
             = backoff * S(w | h')    otherwise, h' being h without its first word
    S(w)     = c(w) / N

``ngram_counts`` gives the count tables themselves, a row for each n-gram hash.

Scale: a block sends six to eight bytes for each distinct n-gram; the commonest word
costs one entry a block. N, the number of words, travels the same way. Nothing is
collected. n-grams are keyed by 64-bit hashes: a collision adds one count to another.

Defined cases: null or blank text has no words and a null score; texts shorter than
``order`` start from the unigram; repeated rows are scored (and counted) each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quadrille.llm.exchange import answer, ask, block_count, by_hash, resolve, runs, unpack, unpack_sorted
from quadrille.llm.textops import U64, mix, rolling, span_hashes, utf8_column, windows_in_docs, word_spans

SCHEMA = "doc_id long, n_words long, log_score double"
#: Larger blocks repeat more of their n-grams and send fewer.
LEAST_BLOCK = 4 << 20
#: The key under which the number of words itself is counted.
_ALL = np.array([0x5851F42D4C957F2D], dtype=U64)


class _Words:
    """The words of a block's documents; n-grams are made an order at a time."""

    def __init__(self, table: pa.Table):
        data, offsets = utf8_column(table["text"])
        starts, ends, self.first = word_spans(data, offsets)
        self.hashes = span_hashes(data, starts, ends)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams and the index of their first words."""
        at, _ = windows_in_docs(self.first, n)
        return (mix(rolling(self.hashes, n)[at]) if len(at) else np.zeros(0, U64)), at

    def counted(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams sorted, and how often each occurs."""
        ordered = np.sort(self.grams(n)[0])
        head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
        return ordered[head], np.diff(np.append(head, len(ordered))).astype(U64)


def _summed(keys, table):
    """By key: the order, the run of equal keys and each run's count."""
    counts = np.concatenate([unpack(v, U64) for v in table["vals"].to_pylist()])
    by = np.argsort(keys, kind="stable")
    run = runs(keys[by])
    return by, run, np.add.reduceat(counts[by], np.flatnonzero(np.diff(run, prepend=-1)))


def _sum(keys, owner, table):
    by, run, total = _summed(keys, table)
    out = np.empty(len(keys), U64)
    out[by] = total[run]
    return out


def _asked(docs: DataFrame, order: int, block_bytes: int | None):
    src = docs.select("doc_id", "text")
    n, n_ranges = block_count(src, block_bytes, LEAST_BLOCK)
    blocks = by_hash(src, n)

    def keys_of(table: pa.Table):
        words = _Words(table)
        return [(_ALL, np.array([words.first[-1]], U64)), *(words.counted(k) for k in range(1, order + 1))]

    return blocks, ask(blocks, keys_of, n_ranges)


def ngram_counts(docs: DataFrame, order: int = 3, block_bytes: int | None = None) -> DataFrame:
    """The count tables: n (words of the n-gram), gram (its hash), total. n = 0 holds the
    number of words."""

    def rows(table: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack_sorted(x) for x in table["keys"].to_pylist()])
        by, run, total = _summed(keys, table)
        heads = keys[by][np.flatnonzero(np.diff(run, prepend=-1))]
        return pa.table({"n": pa.array(np.full(len(heads), table["stream"][0].as_py(), np.int32)), "gram": pa.array(heads.view(np.int64)), "total": pa.array(total.astype(np.int64))})

    return _asked(docs, order, block_bytes)[1].groupBy("stream", "part").applyInArrow(rows, "n int, gram long, total long")


def lm_score(docs: DataFrame, order: int = 3, backoff: float = 0.4, min_count: int = 1, block_bytes: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, log_score (the sum of ln S over
    its words; null without words). n-grams of two words and more that the corpus
    has fewer than ``min_count`` times count as unseen."""
    blocks, asked = _asked(docs, order, block_bytes)

    def finish(table: pa.Table, replies: list[np.ndarray]) -> pa.Table:
        words = _Words(table)
        n_words = np.diff(words.first)
        total = int(words.first[-1])
        log = np.zeros(total)
        if total:
            place = np.arange(total) - np.repeat(words.first[:-1], n_words)
            longest = np.minimum(place, order - 1)
            before = None
            for k in range(1, order + 1):  # the longest seen wins
                hashes, at = words.grams(k)
                distinct = np.unique(hashes)
                count = replies[k][np.searchsorted(distinct, hashes)].astype(np.float64)
                del hashes, distinct
                last = at + k - 1
                if k == 1:
                    log = np.log(count / float(replies[0][0])) + longest * np.log(backoff)
                else:
                    good = count >= min_count
                    last = last[good]
                    log[last] = np.log(count[good] / before[at[good]]) + (longest[last] - (k - 1)) * np.log(backoff)
                before = np.zeros(total)  # counts by first word
                before[at] = count
        doc = np.repeat(np.arange(len(n_words)), n_words)
        score = np.bincount(doc, weights=log, minlength=len(n_words))
        return pa.table([table["doc_id"], pa.array(n_words), pa.array(score, mask=n_words == 0)], names=["doc_id", "n_words", "log_score"])

    return resolve(blocks, answer(asked, _sum), finish, U64, order + 1, SCHEMA)
