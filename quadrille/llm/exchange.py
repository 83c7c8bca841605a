"""A two-way exchange between blocks of documents and ranges of the hash space.

An operator that must know, for each key of a block (a word window, an n-gram, an
anchor), what the rest of the corpus holds of that key, does three things:

1. each block sends its *distinct sorted* keys, cut at the range bounds, as one
   compressed column per range (``requests``);
2. each range merges the columns of all blocks and answers every column in its own
   order, so that an answer carries no keys (``answers``);
3. the block's documents meet its answers in a cogroup (``resolve``).

That is a shuffle join on the key's hash with map-side combining; rows are columns
of a block instead of single keys, which takes six bytes a key rather than forty.
A key in every document costs a range one entry a block, never one a document.

Documents travel to their blocks packed: a task sends one compressed row for each block
and PACK_BYTES of its text. A document's block follows from the document alone, so a task
that is run again sends the same documents to the same blocks.
"""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.textops import U64, give_back, text_bytes, utf8_column

#: Bytes that a block should send to a range; bounds of a block; text that a task packs at once.
ROW_BYTES, LEAST_BLOCK, MOST_BLOCK, PACK_BYTES = 2 << 10, 2 << 20, 32 << 20, 32 << 20
PACKED = "block long, docs binary"
#: Stands for a null doc_id in the order of ranges.
_NO_ID = -(1 << 63)
REQUEST = "block long, stream int, part int, keys binary, vals binary"
ANSWER = "block long, stream int, part int, reply binary"
_REQUEST_ARROW = pa.schema([("block", pa.int64()), ("stream", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary())])
_ANSWER_ARROW = pa.schema([("block", pa.int64()), ("stream", pa.int32()), ("part", pa.int32()), ("reply", pa.binary())])


def pack(values: np.ndarray) -> bytes:
    """Byte planes of an integer array, compressed; planes of zeros cost nothing."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=U64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, U64), dtype=U64)


def block_count(docs: DataFrame, block_bytes: int | None = None, least: int = LEAST_BLOCK, most: int = MOST_BLOCK) -> tuple[int, int]:
    """Blocks and ranges of the exchange. Each block sends a row to each range, so both
    should grow with the square root of the input for rows to stay worth their overhead: a
    range has the geometric mean of the input and ROW_BYTES, ``least`` at least (8 MB of 30 GB,
    0.45 GB of 100 TB), and so has a block up to ``most``, which bounds what a task holds."""
    total = text_bytes(docs)
    mean = max(least, int((total * ROW_BYTES) ** 0.5))
    return tuple(max(2, -(-total // size)) for size in (block_bytes or min(most, mean), block_bytes or mean))


def freeing(f: Callable) -> Callable:
    """``f``, which gives memory back to the system when it ends."""

    def one(table):
        out = f(table)
        give_back()
        return out

    def two(table, other):
        out = f(table, other)
        give_back()
        return out

    return one if f.__code__.co_argcount == 1 else two  # Spark looks at the number of arguments


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, doc_id, text to rows of PACKED."""

    def rows(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        block = table["block"].to_numpy()
        order = np.argsort(block, kind="stable")
        table, block = table.take(pa.array(order)), block[order]
        edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
        data, offsets = utf8_column(table["text"])
        ids = table["doc_id"].combine_chunks()
        null = ids.is_null().to_numpy(zero_copy_only=False) + 2 * table["text"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        zip_ = zstandard.ZstdCompressor(level=3)
        blobs = []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            head = np.array([b - a], np.int64).tobytes() + ids[a:b].tobytes() + np.diff(offsets[a : b + 1]).tobytes() + null[a:b].astype(np.uint8).tobytes()
            blobs.append(zip_.compress(head + data[offsets[a] : offsets[b]].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(block[edge[:-1]]), pa.array(blobs, pa.binary())], names=["block", "docs"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= PACK_BYTES:
            yield rows(held)
            held, size = [], 0
    if held:
        yield rows(held)


def unpacked(table: pa.Table) -> pa.Table:
    """doc_id, text of the rows of a block."""
    ids, none, sizes, texts = [], [], [], []
    for blob in table["docs"].to_pylist():
        raw = memoryview(zstandard.ZstdDecompressor().decompress(blob))
        n = int(np.frombuffer(raw[:8], np.int64)[0])
        ids.append(np.frombuffer(raw[8 : 8 + 8 * n], np.int64))
        sizes.append(np.frombuffer(raw[8 + 8 * n : 8 + 16 * n], np.int64))
        none.append(np.frombuffer(raw[8 + 16 * n : 8 + 17 * n], np.uint8))
        texts.append(raw[8 + 17 * n :])
    if not ids:
        return pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.large_string())})
    null = np.concatenate(none)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
    valid = pa.py_buffer(np.packbits((null & 2) == 0, bitorder="little"))
    text = pa.Array.from_buffers(pa.large_string(), len(null), [valid, pa.py_buffer(offsets), pa.py_buffer(b"".join(texts))])
    return pa.table({"doc_id": pa.array(np.concatenate(ids), mask=(null & 1) > 0), "text": text})


def packed(dealt: DataFrame) -> DataFrame:
    """The dealt documents (block, doc_id, text) as packed rows."""
    return dealt.select("block", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_packer, PACKED)


def by_hash(docs: DataFrame, n: int) -> DataFrame:
    """Documents dealt to ``n`` blocks by a hash of their id and text, packed."""
    return packed(docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))))


def ranged(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` with a column block of about ``n`` ranges of ascending doc_id (null first).
    The bounds are approximate quantiles, n numbers on the driver. A doc_id, or null, that
    takes several quantiles is split by the SHA-256 of the text: rows of one doc_id are in
    that order (``in_order``)."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    marks = docs.select(key.alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.1 / n) or []
    ids, times = np.unique(np.array([min(int(x), (1 << 63) - 1) for x in marks], np.int64), return_counts=True)
    hot = ids[times > 1]
    # after a split doc_id the next range begins
    after = np.setdiff1d(hot[hot < (1 << 63) - 1] + 1, ids)
    edges = np.sort(np.concatenate([np.repeat(ids, times), after]))
    digest = F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 13), 16, 10).cast("double") / float(16**13)
    part = F.when(key.isin(hot.tolist()), digest).otherwise(F.lit(0.0)) if len(hot) else F.lit(0.0)

    def block(ids: pd.Series, part: pd.Series) -> pd.Series:
        low, high = (np.searchsorted(edges, ids.to_numpy(), side) for side in ("left", "right"))
        same = high - low
        return pd.Series(low + np.where(same > 0, np.floor(part.to_numpy() * same).astype(np.int64) + 1, 0))

    return docs.withColumn("block", F.pandas_udf(block, "long")(key, part))


def by_range(docs: DataFrame, n: int) -> DataFrame:
    """Documents dealt to about ``n`` blocks as ``ranged``, packed."""
    return packed(ranged(docs, n))


def in_order(docs: pa.Table) -> pa.Table:
    """doc_id, text ascending: null first, rows of one doc_id by the SHA-256 of their text."""
    docs = docs.take(pc.sort_indices(docs, sort_keys=[("doc_id", "ascending")], null_placement="at_start"))
    ids = docs["doc_id"].combine_chunks()
    none = ids.is_null().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(_NO_ID).to_numpy()
    same = (ids[1:] == ids[:-1]) & (none[1:] == none[:-1])
    if not same.any():
        return docs
    order = np.arange(len(ids))
    edge = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b - a > 1:
            texts = docs["text"].slice(a, b - a).to_pylist()
            digests = [hashlib.sha256((t or "").encode()).digest() for t in texts]
            order[a:b] = a + np.array(sorted(range(b - a), key=lambda i: (digests[i], texts[i] is not None)))
    return docs.take(pa.array(order))


def sent(block: int, streams: list[tuple[np.ndarray, np.ndarray | None]], n_parts: int) -> pa.Table:
    """Request rows of one block. streams: sorted distinct keys and their values."""
    rows = {k: [] for k in _REQUEST_ARROW.names}
    width = (1 << 64) // n_parts + 1
    edges = np.array([i * width for i in range(1, n_parts)], dtype=U64)
    for s, (keys, vals) in enumerate(streams):
        cut = [0, *np.searchsorted(keys, edges, "left").tolist(), len(keys)]
        for p in range(n_parts):
            a, b = cut[p], cut[p + 1]
            if a < b:
                rows["block"].append(block)
                rows["stream"].append(s)
                rows["part"].append(p)
                rows["keys"].append(pack_sorted(keys[a:b]))
                rows["vals"].append(pack(vals[a:b]) if vals is not None else b"")
    return pa.table(rows, schema=_REQUEST_ARROW)


def _by_stream(replies: pa.Table, dtype, n_streams: int) -> list[np.ndarray]:
    order = sorted(zip(replies["stream"].to_pylist(), replies["part"].to_pylist(), replies["reply"].to_pylist(), strict=True), key=lambda x: x[:2])
    got = [[unpack(r, dtype) for s, _, r in order if s == k] for k in range(n_streams)]
    return [np.concatenate(g) if g else np.zeros(0, dtype) for g in got]


def ask(blocks: DataFrame, keys_of: Callable, n_parts: int) -> DataFrame:
    """Requests of all blocks; keys_of gives a block's streams."""

    def send(table: pa.Table) -> pa.Table:
        return sent(table["block"][0].as_py(), keys_of(unpacked(table)), n_parts)

    return blocks.groupBy("block").applyInArrow(freeing(send), REQUEST)


def answer(requests: DataFrame, merge: Callable[[np.ndarray, np.ndarray, list[bytes]], np.ndarray]) -> DataFrame:
    """Each range's answers. merge(keys, owner, vals) gets the keys of all columns in
    block order, the column that each came from, the packed values of each column,
    and returns one integer for each key."""

    def reply(table: pa.Table) -> pa.Table:
        table = table.take(np.argsort(table["block"].to_numpy(), kind="stable"))
        columns = [unpack_sorted(x) for x in table["keys"].to_pylist()]
        sizes = [len(c) for c in columns]
        got = merge(np.concatenate(columns), np.repeat(np.arange(len(sizes)), sizes), table)
        cut = np.cumsum([0, *sizes])
        blobs = [pack(got[cut[i] : cut[i + 1]]) for i in range(len(sizes))]
        return pa.table([table["block"], table["stream"], table["part"], pa.array(blobs, pa.binary())], schema=_ANSWER_ARROW)

    return requests.groupBy("stream", "part").applyInArrow(freeing(reply), ANSWER)


def resolve(blocks: DataFrame, answers: DataFrame, finish: Callable[[pa.Table, list[np.ndarray]], pa.Table], dtype, n_streams: int, schema: str) -> DataFrame:
    """finish(documents of a block, its answers by stream in key order) gives rows."""

    def meet(docs: pa.Table, replies: pa.Table) -> pa.Table:
        return finish(unpacked(docs), _by_stream(replies, dtype, n_streams))

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(freeing(meet), schema)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Index of each entry's run of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.cumsum(np.concatenate([[False], sorted_keys[1:] != sorted_keys[:-1]]))


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys sorted, the first index of each, and each entry's distinct key."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    run = runs(ordered)
    head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = run
    return ordered[head], order[head], inverse

