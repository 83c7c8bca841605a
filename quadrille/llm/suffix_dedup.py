"""Suffix-array dedup: remove bytes of strings that occur more than once (operator 5).

Suffix arrays of separate shards only meet repeats within a shard, so the shards are made
by content. Every window of ``width`` bytes has an *anchor*: the least hash among its
``gram``-byte substrings, a function of the window alone. Consecutive windows of one
anchor form a *segment* of text; equal windows always lie in segments of equal anchor.

1. Blocks of documents send anchor and digest of their segments through the hash
   exchange. An anchor met once needs nothing more. Equal segments are one string of
   weight two and more, repeated as a whole.
2. Segments that share their anchor with different ones go to the shard of the anchor,
   one copy each. A shard builds the suffix array of its segments by induced sorting and
   their permuted longest common prefixes; suffixes that share ``width`` bytes with a
   neighbour in the array start a repeated window.
3. Blocks meet the answers and mark the bytes that repeated windows cover.

The anchor only routes; equality of windows that are not whole equal segments is decided by the
suffix arrays, byte for byte, and that of whole segments by 62-bit digests within an
anchor.

Scale: text crosses the network once to form blocks, and each distinct segment that needs
sorting once for each block that holds it. An exact copy or passage in every document costs one
small entry a block. A shard sorts its segments in batches of ``batch_bytes``, an
anchor never being cut. The segments of an anchor that has more than ``hot_contexts``
different ones (a line in very many documents) are cut where a second anchor, the greatest
hash of a window, changes, and spread over the shards by both anchors.

Defined cases: null text counts as empty; texts under ``width`` bytes repeat nothing
themselves; equal rows repeat each other; a window may repeat within one document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quadrille.llm.exchange import ANSWER, _ANSWER_ARROW, answer, ask, block_count, by_hash, freeing, unpack, unpacked
from quadrille.llm.suffix import common_prefixes, suffix_array
from quadrille.llm.textops import RADIX, U64, byte_chunks, mix, utf8_column

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
SEGMENT = "shard long, anchor long, block long, entry int, at int, windows int, weight int, segment binary"
_SEGMENT_ARROW = pa.schema([("shard", pa.int64()), ("anchor", pa.int64()), ("block", pa.int64()), ("entry", pa.int32()), ("at", pa.int32()), ("windows", pa.int32()), ("weight", pa.int32()), ("segment", pa.binary())])
#: A piece of text, whose places are numbered, has fewer bytes than 2**28.
_PLACE_BITS = 28
_PIECE = 1 << 27
#: Bits of an answer: repeated as a whole; wanted by a shard; its anchor has very many contexts.
WHOLE, SORT, HOT = 1, 2, 4
#: A byte that no UTF-8 text holds: between segments in a shard.
_GAP = np.uint8(0xFF)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values."""
    n = len(x)
    m = -(-n // width)
    pad = np.full(m * width - n, np.iinfo(x.dtype).max, x.dtype)
    rows = np.concatenate([x, pad]).reshape(m, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)[width - 1 : n]
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)[: n - width + 1]
    return np.minimum(ahead, behind)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every ``gram`` consecutive bytes; gram is 8 times a power of two."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    h = np.ndarray((len(data) - 7,), dtype="<u8", buffer=padded, strides=(1,)) * U64(RADIX)
    h ^= h >> U64(29)
    span = 8
    while span < gram:
        h = h[:-span] + h[span:] * U64(pow(RADIX, span, 1 << 64))
        span *= 2
    return mix(h)


def _pieces(data: np.ndarray, offsets: np.ndarray, width: int):
    """First byte, each document's start and end in it, bytes: documents of some 2 MB
    together. A longer document is cut into pieces that overlap by a window less a byte."""
    for a, b in byte_chunks(offsets, 1 << 21):
        base, end = int(offsets[a]), int(offsets[b])
        if end - base < width:
            continue
        if end - base <= _PIECE:
            yield base, offsets[a:b] - base, offsets[a + 1 : b + 1] - base, data[base:end]
            continue
        for at in range(base, end - width + 1, _PIECE):
            part = data[at : min(end, at + _PIECE + width - 1)]
            yield at, np.array([0]), np.array([len(part)]), part


def segments(data: np.ndarray, offsets: np.ndarray, width: int, gram: int):
    """Segments of all documents: anchor, first window, windows, whether the anchor
    occurs again within. A chunk's windows never cross documents."""
    keys, firsts, counts, again = [], [], [], []
    for base, lo, hi, part in _pieces(data, offsets, width):
        h = gram_hashes(part, gram)
        place = np.arange(len(h), dtype=U64)
        least = sliding_min((h >> U64(_PLACE_BITS) << U64(_PLACE_BITS)) | place, width - gram + 1)
        least &= U64((1 << _PLACE_BITS) - 1)
        at = least.astype(np.int64)
        key = h[at]
        valid = np.zeros(len(key) + 1, np.int64)
        hi = np.minimum(np.maximum(hi - width + 1, lo), len(key))
        live = hi > lo
        np.add.at(valid, lo[live], 1)
        np.add.at(valid, hi[live], -1)
        valid = np.cumsum(valid)[:-1] > 0
        new = valid.copy()
        new[1:] &= (key[1:] != key[:-1]) | ~valid[:-1]
        new[lo[live]] = True
        head = np.flatnonzero(new)
        stop = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True)) + 1
        keys.append(mix(key[head]))  # least hashes are small: spread them over the ranges
        firsts.append(head + base)
        counts.append(stop - head)
        again.append(at[head] != at[stop - 1])
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(keys), np.concatenate(firsts), np.concatenate(counts), np.concatenate(again)


class _Block:
    """The segments of a block and its distinct ones (entries), in key order."""

    def __init__(self, table: pa.Table, width: int, gram: int):
        self.data, self.offsets = utf8_column(table["text"])
        self.key, self.first, self.windows, again = segments(self.data, self.offsets, width, gram)
        view = memoryview(np.ascontiguousarray(self.data))
        ends = (self.first + self.windows + width - 1).tolist()
        digest = b"".join(hashlib.blake2b(view[s:e], digest_size=8).digest() for s, e in zip(self.first.tolist(), ends, strict=True))
        self.digest = np.frombuffer(digest, "<u8") >> U64(2) << U64(2)
        order = np.lexsort((self.digest, self.key))
        k, d = self.key[order], self.digest[order]
        head = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])]) if len(order) else np.zeros(0, bool)
        self.entry_of = np.empty(len(order), np.int64)
        self.entry_of[order] = np.cumsum(head) - 1
        self.sample = order[head]  # one segment of each entry
        many = np.bincount(self.entry_of, minlength=len(self.sample)) > 1
        self.keys = self.key[self.sample]
        self.values = self.digest[self.sample] | many.astype(U64) | (again[self.sample].astype(U64) << U64(1))


def _codes(hot_contexts: int):
    def codes(keys, owner, table):
        """What each entry of a range needs; entries come in block order."""
        values = np.concatenate([unpack(v, U64) for v in table["vals"].to_pylist()])
        digest = values >> U64(2)
        order = np.lexsort((owner, digest, keys))
        k, d, v = keys[order], digest[order], values[order]
        new_key = np.concatenate([[True], k[1:] != k[:-1]])
        new_string = new_key | np.concatenate([[True], d[1:] != d[:-1]])
        string, group = np.cumsum(new_string) - 1, np.cumsum(new_key) - 1
        weight = np.bincount(string) + np.bincount(string, weights=(v & U64(1)).astype(float))
        whole = weight[string] > 1
        contexts = np.bincount(group[new_string])[group]
        sort = ~whole & ((contexts > 1) | ((v & U64(2)) > 0))
        needed = np.bincount(group, weights=sort)[group] > 0
        wanted = sort | (whole & new_string & needed)  # one copy of a whole string is a partner
        out = np.empty(len(keys), np.uint8)
        out[order] = whole * WHOLE + wanted * SORT + (wanted & (contexts > hot_contexts)) * HOT
        return out

    return codes


def _short_runs(data: np.ndarray, most: int) -> np.ndarray:
    """Which bytes stay where a run of one byte keeps its last ``most``."""
    head = np.flatnonzero(np.concatenate([[True], data[1:] != data[:-1]]))
    size = np.diff(np.append(head, len(data)))
    keep = np.ones(len(data), bool)
    for a, n in zip(head[size > most].tolist(), size[size > most].tolist(), strict=True):
        keep[a : a + n - most] = False
    return keep


def _sort_batch(parts: list[bytes], windows: np.ndarray, width: int) -> np.ndarray:
    """For the windows of all segments in turn: does another window equal it?

    Induced sorting takes a step for each byte of a run of one byte. Windows within a run
    over width + 1 bytes all equal each other, and no window reaches both its ends, so runs
    are cut to that: a window at a byte that goes is the one at the first byte that stays."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    data = np.frombuffer(b"\xff".join([*parts, b""]), np.uint8)
    first = np.cumsum(sizes) - sizes
    keep = _short_runs(data, width + 1)
    data = data[keep]
    new_place = np.cumsum(keep) - keep
    sa = suffix_array(data)
    plcp, phi = common_prefixes(data, sa)
    near = np.flatnonzero(plcp >= width)
    repeated = np.zeros(len(data), bool)
    repeated[near] = True
    repeated[phi[near]] = True
    at = np.arange(int(windows.sum())) + np.repeat(first - (np.cumsum(windows) - windows), windows)
    # a common prefix may go on past a segment's end only beyond its last window
    return repeated[new_place[at]]


def _second_anchor(part: bytes, windows: int, width: int, gram: int):
    """Cuts a segment where its windows' greatest gram hash changes: (hash, first, windows)."""
    h = ~gram_hashes(np.frombuffer(part, np.uint8), gram)
    least = sliding_min(h, width - gram + 1)[:windows]
    head = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return zip(least[head].tolist(), head.tolist(), np.diff(np.append(head, windows)).tolist(), strict=True)


def suffix_dedup(docs: DataFrame, width: int = 400, gram: int = 64, block_bytes: int | None = None, batch_bytes: int = 4 << 20, hot_contexts: int = 4096) -> DataFrame:
    """Remove every byte covered by a ``width``-byte string that also starts anywhere
    else. One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept (the remaining bytes)."""
    src = docs.select("doc_id", "text")
    n, n_ranges = block_count(src, block_bytes)
    blocks = by_hash(src, n)

    def keys_of(table: pa.Table):
        block = _Block(table, width, gram)
        return [(block.keys, block.values)]

    def codes_by_entry(replies: pa.Table) -> np.ndarray:
        got = sorted((p, r) for s, p, r in zip(replies["stream"].to_pylist(), replies["part"].to_pylist(), replies["reply"].to_pylist(), strict=True) if s == 0)
        return np.concatenate([unpack(r, np.uint8) for _, r in got]) if got else np.zeros(0, np.uint8)

    def send(table: pa.Table, replies: pa.Table) -> pa.Table:
        own = table["block"][0].as_py() if table.num_rows else 0
        block = _Block(unpacked(table), width, gram)
        codes = codes_by_entry(replies)
        view = memoryview(np.ascontiguousarray(block.data))
        rows: list[tuple] = []
        for e in np.flatnonzero(codes & SORT).tolist():
            k = block.sample[e]
            first, windows, key = int(block.first[k]), int(block.windows[k]), int(block.keys[e])
            text, weight = bytes(view[first : first + windows + width - 1]), int(codes[e] & WHOLE)
            if codes[e] & HOT:
                for second, at, n_windows in _second_anchor(text, windows, width, gram):
                    rows.append((key ^ second, e, at, n_windows, weight, text[at : at + n_windows + width - 1]))
            else:
                rows.append((key, e, 0, windows, weight, text))
        key, entry, at, windows, weight, texts = zip(*rows, strict=True) if rows else [()] * 6
        key = mix(np.array(key, U64))
        columns = [(key % U64(4 * n)).astype(np.int64), key.view(np.int64), np.full(len(key), own), *(np.array(c, np.int32) for c in (entry, at, windows, weight))]
        return pa.table([*map(pa.array, columns), pa.array(texts, pa.binary())], schema=_SEGMENT_ARROW)

    def sort(table: pa.Table) -> pa.Table:
        table = table.sort_by([("anchor", "ascending"), ("block", "ascending"), ("entry", "ascending"), ("at", "ascending")])
        anchor, windows, weight = (table[c].to_numpy() for c in ("anchor", "windows", "weight"))
        parts = table["segment"].to_pylist()
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        edge = np.append(np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])), len(anchor))
        bits: list[np.ndarray] = []
        a, total = 0, np.concatenate([[0], np.cumsum(sizes)])
        for i in range(1, len(edge)):
            last = i == len(edge) - 1
            if last or total[edge[i + 1]] - total[edge[a]] > batch_bytes:
                lo, hi = edge[a], edge[i]
                flags = _sort_batch(parts[lo:hi], windows[lo:hi], width)
                bits.extend(np.split(flags, np.cumsum(windows[lo:hi])[:-1]))
                a = i
        wanted = np.flatnonzero(weight == 0)
        replies = [np.packbits(bits[i]).tobytes() for i in wanted.tolist()]
        rows = table.take(wanted)
        stream = pa.array(rows["at"].to_numpy() + 1, pa.int32())  # 0 is the codes' own
        return pa.table([rows["block"], stream, rows["entry"], pa.array(replies, pa.binary())], schema=_ANSWER_ARROW)

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        table = unpacked(table)
        block = _Block(table, width, gram)
        codes = codes_by_entry(replies)
        cover = np.zeros(len(block.data) + 1, np.int64)
        if len(codes):
            whole = (codes[block.entry_of] & WHOLE) > 0
            np.add.at(cover, block.first[whole], 1)
            np.add.at(cover, block.first[whole] + block.windows[whole] + width - 1, -1)
        for stream, entry, bits in zip(replies["stream"].to_pylist(), replies["part"].to_pylist(), replies["reply"].to_pylist(), strict=True):
            if stream:
                k = block.sample[entry]
                hit = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))) + block.first[k] + stream - 1
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + width, -1)
        gone = np.cumsum(cover)[:-1] > 0
        before = np.concatenate([[0], np.cumsum(gone)])
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        inner = block.offsets[:-1][block.offsets[:-1] < len(gone)]
        begin[inner] = gone[inner]
        begun = np.concatenate([[0], np.cumsum(begin)])
        kept = block.data[~gone]
        removed = np.diff(before[block.offsets])
        sizes = np.diff(block.offsets)
        offsets = np.concatenate([[0], np.cumsum(sizes - removed)]).astype(np.int32)
        column = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))])
        return pa.table([table["doc_id"].cast(pa.int64()), pa.array(sizes), pa.array(removed), pa.array(np.diff(begun[block.offsets])), column], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    codes = answer(ask(blocks, keys_of, max(1, n_ranges // 8)), _codes(hot_contexts))  # a segment is some 170 windows
    shipped = blocks.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(freeing(send), SEGMENT)
    sorted_ = shipped.groupBy("shard").applyInArrow(freeing(sort), ANSWER)
    replies = codes.unionByName(sorted_)
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(freeing(finish), SCHEMA)
