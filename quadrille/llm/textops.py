"""Vectorised text primitives shared by the Arrow operators.

Everything works on the raw UTF-8 buffer of an Arrow string column, so the cost
is a handful of numpy passes and no Python object is made per word.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_M1, _M2, _M3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Odd multiplier of the rolling hash over words or bytes.
RADIX = 0xD6E8FEB86659FD93
#: Words longer than this (bytes) are hashed one at a time.
LONG_WORD = 1024

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: a bijection on 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * _M2
    x ^= x >> U64(27)
    x *= _M3
    x ^= x >> U64(31)
    return x


def utf8_column(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # combine_chunks keeps chunks only beyond 2 GB
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks])
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if off is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends of the words ``[^\\x20\\x09-\\x0D]+`` and, per document, the
    index of its first word (n_docs + 1). No word crosses a document's end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = False
    starts = np.flatnonzero(word & ~before)
    after = before
    after[:-1] = word[1:]
    after[-1] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes a step."""
    n = len(starts)
    if not n:
        return np.zeros(0, U64)
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    h = mix(size.astype(U64) * _M1)
    tail = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=U64)
    live, at, left, cur = None, starts, size, h
    step = 0
    while True:
        cur = mix((cur ^ (eight[at] & tail[np.minimum(left, 8)])) * _M1)
        if live is None:
            h = cur
        else:
            h[live] = cur
        step += 8
        more = np.flatnonzero(left > 8)
        if not len(more) or step >= LONG_WORD:
            break
        live = more if live is None else live[more]
        at, left, cur = at[more] + 8, left[more] - 8, cur[more]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive entries (len(h) - width + 1), by doubling."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    power, have, span, out, taken = h, 1, 1, None, 0
    bits = width
    while True:
        if bits & 1:
            if out is None:
                out, taken = power, have
            else:
                shift = U64(pow(RADIX, taken, 1 << 64))
                m = len(h) - (taken + have) + 1
                out = out[:m] + power[taken : taken + m] * shift
                taken += have
        bits >>= 1
        if not bits:
            break
        m = len(power) - have
        power = power[:m] + power[have:] * U64(pow(RADIX, have, 1 << 64))
        have *= 2
    return out[:n]


def windows_in_docs(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start indexes of the windows of ``width`` entries that lie within one
    document, given each document's first entry (n + 1), and windows per document."""
    count = np.maximum(np.diff(first) - width + 1, 0)
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64), count
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(first[:-1] - (ends - count), count), count


def byte_chunks(offsets: np.ndarray, most: int):
    """Ranges [a, b) of documents of at most ``most`` bytes, or of one longer document."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def text_bytes(docs) -> int:
    """Bytes of the text column: Catalyst's estimate, which for files is their size, or a
    sum over the column where Catalyst knows nothing (it then says 2**62 and more)."""
    text = docs.select("text")
    known = int(str(text._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 60 else int(text.selectExpr("coalesce(sum(octet_length(text)), 0)").first()[0])


def sha256_hex(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def give_back() -> None:
    """Returns freed memory to the system: an idle worker keeps none of a task's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # other C libraries return it themselves
        pass
