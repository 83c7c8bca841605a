"""Substring dedup: relative Lempel-Ziv parsing of every document against the
corpus before it (operator 3).

Documents are cut into blocks of ascending doc_id. Each block is a *reference*: its words
in order and a sorted index of its word windows.

1. The hash exchange names, for each distinct window of a block, the first block that holds
   it, so a document meets only those references that can serve it, not all of them.
2. Consecutive windows that one reference holds form a *stretch* of words. Stretches travel
   to their reference, equal ones once. There each is parsed greedily: at a word, the
   reference's earliest occurrence of the window is followed, word by word, as far as the
   two agree; that is a factor, and the parse goes on behind it. Factors, and the windows
   across factor boundaries, which are looked up on their own, count only where their bytes
   equal the reference's.
3. Factors come back to their documents and become duplicate spans. Repeats within a block
   are parsed against the block's own earlier words in the same way.

Scale: text crosses the network once to form blocks, and each distinct stretch once to be
parsed; besides, about six bytes for each distinct window of a block. A passage in every
document costs one entry a block, and is combined to one row before it reaches its
reference. Where very many different stretches have one reference (a large group of near
copies), they are dealt to salts, each with a copy of the reference. A hot source or doc_id
is only more blocks.

Defined cases: null or blank text has no words; a text shorter than a window keeps
all its words; a null doc_id comes before all others; rows of one doc_id (or of none) are
taken in the order of their text's SHA-256; equal rows are taken one after the other, so
the second is a copy of the first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.exchange import answer, ask, block_count, by_range, freeing, groups, in_order, runs, unpack, unpacked
from quadrille.llm.textops import U64, mix, rolling, span_hashes, text_bytes, utf8_column, windows_in_docs, word_spans

SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string, factors array<struct<start: long, length: long, reference: long, position: long>>"
_FACTOR = pa.struct([(x, pa.int64()) for x in ("start", "length", "reference", "position")])
_STRETCH = "reference long, digest binary, block long, words binary"
_PARSED = "reference long, digest binary, blocks array<long>, factors binary"
_SENT = ["reference", "digest", "words", "blocks"]
_STRETCH_ARROW = pa.schema([("reference", pa.int64()), ("digest", pa.binary()), ("block", pa.int64()), ("words", pa.binary())])
_PARSED_ARROW = pa.schema([("reference", pa.int64()), ("digest", pa.binary()), ("blocks", pa.list_(pa.int64())), ("factors", pa.binary())])


class Words:
    """Words of texts in order, each closed by one blank in ``text``; ``edge``: where they
    start in it (n + 1); ``first``: each text's first word (n + 1)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, self.first = word_spans(data, offsets)
        size = ends - starts + 1
        self.edge = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        out = np.full(int(self.edge[-1]), 0x20, np.uint8)
        inner = np.ones(len(out), bool)
        inner[self.edge[1:] - 1] = False
        cover = np.zeros(len(data) + 1, np.int8)
        np.add.at(cover, starts, 1)
        np.add.at(cover, ends, -1)
        out[inner] = data[np.cumsum(cover[:-1], dtype=np.int8) > 0]
        self.text = memoryview(out)
        self.hashes = span_hashes(data, starts, ends)

    def bytes(self, a: int, b: int):
        """The words [a, b)."""
        return self.text[self.edge[a] : self.edge[b]]

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of every window that lies within a text."""
        at, _ = windows_in_docs(self.first, width)
        return (mix(rolling(self.hashes, width)[at]) if len(at) else np.zeros(0, U64)), at


class Reference:
    """Words with a sorted index of their windows: the earliest place of each."""

    def __init__(self, words: Words, width: int):
        self.words, self.width = words, width
        hashes, at = words.windows(width)
        self.keys, head, self.inverse = groups(hashes)
        self.places, self.at = at[head], at
        self.stop = words.first[np.searchsorted(words.first, self.places, "right")]  # where the place's text ends

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each window's key, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        k = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[k] == hashes, k, -1)

    def parse(self, other: Words, a: int, b: int, found: np.ndarray) -> list[tuple[int, int, int]]:
        """Greedy factors of the words [a, b) of ``other``, and windows across their
        boundaries: (first word, words, place here). found: ``find`` of the windows at
        a .. b - width."""
        width, out, i, last, behind = self.width, [], a, b - self.width, None
        while i <= last:
            k = found[i - a]
            size = 0
            if k >= 0:
                p = int(self.places[k])
                most = min(b - i, int(self.stop[k]) - p)
                differ = np.flatnonzero(other.hashes[i : i + most] != self.words.hashes[p : p + most])
                size = int(differ[0]) if len(differ) else most
            if size >= width and other.bytes(i, i + size) == self.words.bytes(p, p + size):
                out.append((i, size, p))
                # windows that begin in this factor and end behind it
                behind = range(i + size - width + 1, min(i + size, last + 1))
                i += size
            else:
                behind = None
                i += 1
            for j in behind or ():
                k = found[j - a]
                if k >= 0 and other.bytes(j, j + width) == self.words.bytes(p := int(self.places[k]), p + width):
                    out.append((j, width, p))
        return out


def _words(table: pa.Table) -> Words:
    return Words(*utf8_column(table["text"]))


def _stretches(source: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows of one source (-1: none): first word, words, source."""
    if not len(source):
        return (np.zeros(0, np.int64),) * 3
    new = np.concatenate([[True], (source[1:] != source[:-1]) | (at[1:] != at[:-1] + 1)])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(source)))
    hit = source[head] >= 0
    return at[head[hit]], size[hit] + width - 1, source[head[hit]]


def _digest(words) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def _first_reference(keys, owner, table):
    blocks = table["block"].to_numpy()
    order = np.argsort(keys, kind="stable")  # columns come in block order: the first of a run is the earliest
    ordered = keys[order]
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    earliest = blocks[owner[order][head]][runs(ordered)]
    out = np.zeros(len(keys), np.uint32)
    out[order] = np.where(head, 0, earliest + 1)
    return out


def _sources(replies: pa.Table, reference: Reference) -> np.ndarray:
    """Per window, the earlier block that holds it, or -1."""
    order = sorted(zip(replies["part"].to_pylist(), replies["reply"].to_pylist(), strict=True))
    got = np.concatenate([unpack(r, np.uint32) for _, r in order]) if order else np.zeros(0, np.uint32)
    return got[reference.inverse].astype(np.int64) - 1


def _send(width: int):
    def send(table: pa.Table, replies: pa.Table) -> pa.Table:
        """The distinct stretches of a block that other blocks hold."""
        block = table["block"][0].as_py() if table.num_rows else 0
        words = _words(in_order(unpacked(table)))
        reference = Reference(words, width)
        rows = {}
        for start, size, source in zip(*(x.tolist() for x in _stretches(_sources(replies, reference), reference.at, width)), strict=True):
            part = words.bytes(start, start + size)
            rows.setdefault((source, _digest(part)), part)
        return pa.table([[s for s, _ in rows], [d for _, d in rows], [block] * len(rows), [bytes(x) for x in rows.values()]], schema=_STRETCH_ARROW)

    return send


def _parse(width: int):
    def parse(table: pa.Table, stretches: pa.Table) -> pa.Table:
        """Stretches against the reference block that holds their windows."""
        own = stretches["reference"].to_pylist()
        if not own:
            return _PARSED_ARROW.empty_table()
        reference = Reference(_words(in_order(unpacked(table))), width)
        column = stretches["words"].combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        other = Words(*utf8_column(column))
        hashes, at = other.windows(width)
        found = reference.find(hashes)
        edge = np.searchsorted(at, other.first)
        blobs = []
        for i in range(len(own)):
            a, b = int(other.first[i]), int(other.first[i + 1])
            got = reference.parse(other, a, b, found[edge[i] : edge[i + 1]])
            blobs.append(np.array([(s - a, n, p) for s, n, p in got], np.int64).tobytes())
        return pa.table([stretches["reference"], stretches["digest"], stretches["blocks"].cast(pa.list_(pa.int64())), pa.array(blobs, pa.binary())], schema=_PARSED_ARROW)

    return parse


def _own_factors(reference: Reference, sources: np.ndarray) -> list[tuple[int, int, int]]:
    """Factors against earlier words of the same block, for windows that no earlier block
    holds. Stretches end where the earliest place moves, so an overlap with itself is no
    harm; bytes are compared."""
    words, width = reference.words, reference.width
    place = reference.places[reference.inverse]
    later = (sources < 0) & (place < reference.at)
    out = []
    start, size, shift = _stretches(np.where(later, reference.at - place, -1), reference.at, width)
    for a, n, back in zip(start.tolist(), size.tolist(), shift.tolist(), strict=True):
        if words.bytes(a, a + n) == words.bytes(a - back, a - back + n):
            out.append((a, n, a - back))
        else:  # two windows of one hash that differ
            out += [(j, width, j - back) for j in range(a, a + n - width + 1) if words.bytes(j, j + width) == words.bytes(j - back, j - back + width)]
    return out


def _finish(width: int):
    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        block = table["block"][0].as_py() if table.num_rows else 0
        table = in_order(unpacked(table))
        words = _words(table)
        reference = Reference(words, width)
        answers = replies.filter(pc.is_valid(replies["part"]))
        sources = _sources(answers, reference)
        parsed = replies.filter(pc.is_null(replies["part"]))
        by = {(r, d): f for r, d, f in zip(parsed["reference"].to_pylist(), parsed["digest"].to_pylist(), parsed["reply"].to_pylist(), strict=True)}
        own = _own_factors(reference, sources)
        found = [np.array([(a, n, block, p) for a, n, p in own], np.int64).reshape(-1, 4)]
        for start, size, source in zip(*(x.tolist() for x in _stretches(sources, reference.at, width)), strict=True):
            got = np.frombuffer(by[source, _digest(words.bytes(start, start + size))], np.int64).reshape(-1, 3)
            found.append(np.column_stack([got[:, 0] + start, got[:, 1], np.full(len(got), source), got[:, 2]]))
        factors = np.concatenate(found)
        factors = factors[np.argsort(factors[:, 0], kind="stable")]
        first = words.first
        n_words = np.diff(first)
        cover = np.zeros(int(first[-1]) + 1, np.int64)
        np.add.at(cover, factors[:, 0], 1)
        np.add.at(cover, factors[:, 0] + factors[:, 1], -1)
        gone = np.cumsum(cover)[:-1] > 0
        before = np.concatenate([[0], np.cumsum(gone)])
        removed = before[first[1:]] - before[first[:-1]]
        # kept words, joined by one blank: the words' bytes without those removed, each text without its last blank
        keep = np.repeat(~gone, np.diff(words.edge))
        kept = np.asarray(words.text)[keep]
        size = np.concatenate([[0], np.cumsum(keep)])
        edge = size[words.edge[first]]
        sizes = np.diff(edge)
        last = edge[1:][sizes > 0] - 1
        kept = np.delete(kept, last)
        offsets = np.concatenate([[0], np.cumsum(sizes - (sizes > 0))]).astype(np.int64)
        text = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))]).cast(pa.string())
        doc = np.searchsorted(first, factors[:, 0], "right") - 1
        spans = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (factors[:, 0] - first[doc], factors[:, 1], factors[:, 2], factors[:, 3])], fields=list(_FACTOR))
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(table.num_rows + 1), "left").astype(np.int32)), spans)
        return pa.table([table["doc_id"], pa.array(n_words), pa.array(removed), text, lists], names=["doc_id", "n_words", "n_removed", "kept_text", "factors"])

    return finish


def substring_dedup(docs: DataFrame, width: int = 20, block_bytes: int | None = None, stretch_bytes: int | None = None) -> DataFrame:
    """Remove every word covered by a window of ``width`` words that also starts
    earlier. One row per row of ``docs``: doc_id, n_words, n_removed, kept_text and
    the factors (first word, words, reference block, place among its words)."""
    src = docs.select("doc_id", "text")
    n, n_ranges = block_count(src, block_bytes)
    blocks = by_range(src, n)
    stretch_bytes = stretch_bytes or -(-text_bytes(src) // n)

    def keys_of(table: pa.Table):
        found = np.sort(_words(table).windows(width)[0])
        return [(found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found, None)]

    answers = answer(ask(blocks, keys_of, n_ranges), _first_reference)
    sent = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(freeing(_send(width)), _STRETCH)
    # the blocks that wait for a stretch: 8 bytes each
    distinct = sent.groupBy("reference", "digest").agg(F.any_value("words").alias("words"), F.collect_list("block").alias("blocks"))
    size = F.sum(F.octet_length("words") + 8 * F.size("blocks"))
    # a copy of a block is made for as much text as it has, four times over
    salts = distinct.groupBy("reference").agg(F.ceil(size / (4 * stretch_bytes)).alias("salts"))
    dealt = distinct.join(salts, "reference").withColumn("salt", F.pmod(F.xxhash64("digest"), "salts"))
    parse = freeing(_parse(width))
    parsed = blocks.groupBy("block").cogroup(dealt.where("salts = 1").select(_SENT).groupBy("reference")).applyInArrow(parse, _PARSED)
    copies = blocks.join(salts.where("salts > 1").withColumnRenamed("reference", "block"), "block").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    hot = copies.groupBy("block", "salt").cogroup(dealt.where("salts > 1").select(*_SENT, "salt").groupBy("reference", "salt")).applyInArrow(parse, _PARSED)
    back = parsed.unionByName(hot).select("reference", "digest", "factors", F.explode("blocks").alias("block"))
    none = F.lit(None)
    replies = answers.select("block", "part", "reply", none.cast("long").alias("reference"), none.cast("binary").alias("digest"))
    replies = replies.unionByName(back.select("block", none.cast("int").alias("part"), F.col("factors").alias("reply"), "reference", "digest"))
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(freeing(_finish(width)), SCHEMA)
