"""Exact dedup through counting quotient filters (operator 2).

Every text gets a 64-bit fingerprint. Each partition builds a counting quotient
filter of its fingerprints: the high bits (quotient) name a slot, the low bits
(remainder) are kept sorted within the slot, each with a counter. Filters merge
without loss by merging the sorted remainders of equal slots and adding counters.
Fingerprints counted more than once route their documents to byte verification:
these group by the text itself, so that a collision of fingerprints never merges
two texts. The others are done.

Scale: a partition sends one column for each slot range, at most one entry for each
distinct fingerprint; there is a range for each RANGE_BYTES of text. The groups of copies,
and rows of one doc_id in them, are pre-aggregated map-side; in the join that
hands each copy its group, a group over SALT_ROWS copies is dealt to as many salts as its
fingerprint's counter calls for.

Defined cases: null text counts as empty (one group with the empty texts); null
doc_ids are smaller than all others; of rows that repeat both text and the largest
doc_id one is kept.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.exchange import pack, pack_sorted, unpack, unpack_sorted
from quadrille.llm.textops import U64, text_bytes

#: Copies that meet in one task when their group is handed out.
SALT_ROWS = 1024
#: Text whose fingerprints are merged in one task; least ranges and bits of a quotient.
RANGE_BYTES, LEAST_RANGES, LEAST_QBITS = 8 << 30, 64, 16


class CountingQuotientFilter:
    """``slots``: entries in each quotient's run; ``remainders``: sorted in each run;
    ``counts``: of each remainder. Quotients cover [first, first + len(slots))."""

    def __init__(self, qbits: int, first: int, slots: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.qbits, self.first, self.slots, self.remainders, self.counts = qbits, first, slots, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, qbits: int) -> "CountingQuotientFilter":
        keys, counts = np.unique(fingerprints.astype(U64), return_counts=True)
        return cls._of_sorted(keys, counts.astype(U64), qbits, 0, 1 << qbits)

    @classmethod
    def _of_sorted(cls, keys, counts, qbits, first, n_slots):
        rbits = U64(64 - qbits)
        quotient = (keys >> rbits).astype(np.int64) - first
        return cls(qbits, first, np.bincount(quotient, minlength=n_slots).astype(np.uint32), keys & ((U64(1) << rbits) - U64(1)), counts)

    def fingerprints(self) -> np.ndarray:
        quotient = np.repeat(np.arange(self.first, self.first + len(self.slots)).astype(U64), self.slots)
        return (quotient << U64(64 - self.qbits)) | self.remainders

    def cut(self, first: int, end: int) -> "CountingQuotientFilter":
        """The slots [first, end) alone."""
        edge = np.concatenate([[0], np.cumsum(self.slots)]).astype(np.int64)
        a, b = edge[first - self.first], edge[end - self.first]
        return CountingQuotientFilter(self.qbits, first, self.slots[first - self.first : end - self.first], self.remainders[a:b], self.counts[a:b])

    @staticmethod
    def merged(filters: "list[CountingQuotientFilter]") -> "CountingQuotientFilter":
        """All filters cover the same slots; runs merge by sorted remainder."""
        one = filters[0]
        keys = np.concatenate([f.fingerprints() for f in filters])
        counts = np.concatenate([f.counts for f in filters])
        order = np.argsort(keys, kind="stable")  # timsort-like: the inputs are sorted runs
        keys, counts = keys[order], counts[order]
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        total = np.add.reduceat(counts, head) if len(head) else counts
        return CountingQuotientFilter._of_sorted(keys[head], total, one.qbits, one.first, len(one.slots))

    def to_bytes(self) -> tuple[bytes, bytes, bytes]:
        return pack(self.slots), pack_sorted(self.fingerprints()), pack(self.counts)

    @classmethod
    def from_bytes(cls, qbits: int, first: int, slots: bytes, keys: bytes, counts: bytes) -> "CountingQuotientFilter":
        rbits = U64(64 - qbits)
        return cls(qbits, first, unpack(slots, np.uint32), unpack_sorted(keys) & ((U64(1) << rbits) - U64(1)), unpack(counts, U64))


def _build(qbits: int, n_ranges: int):
    per = (1 << qbits) // n_ranges

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b.column(0).to_numpy(zero_copy_only=False).view(U64) for b in batches if b.num_rows]
        if not got:
            return
        whole = CountingQuotientFilter.of(np.concatenate(got), qbits)
        rows = []
        for r in range(n_ranges):
            part = whole.cut(r * per, (r + 1) * per)
            if len(part.counts):
                rows.append((r, *part.to_bytes()))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["slot_range", "slots", "keys", "counts"])

    return build


def range_count(docs: DataFrame) -> int:
    """Tasks that merge filters, a power of two."""
    return max(LEAST_RANGES, 1 << (text_bytes(docs) // RANGE_BYTES).bit_length())


def repeated_fingerprints(prints: DataFrame, n_ranges: int) -> DataFrame:
    """``prints``: one long column. Rows (fp, fp_count) of those counted twice or more.
    ``n_ranges`` (a power of two) tasks merge the filters."""
    qbits = max(LEAST_QBITS, n_ranges.bit_length() + 1)
    per = (1 << qbits) // n_ranges
    filters = prints.mapInArrow(_build(qbits, n_ranges), "slot_range int, slots binary, keys binary, counts binary")

    def merge(table: pa.Table) -> pa.Table:
        first = table["slot_range"][0].as_py() * per
        parts = [CountingQuotientFilter.from_bytes(qbits, first, *row) for row in zip(table["slots"].to_pylist(), table["keys"].to_pylist(), table["counts"].to_pylist(), strict=True)]
        whole = CountingQuotientFilter.merged(parts)
        more = whole.counts > 1
        return pa.table({"fp": pa.array(whole.fingerprints()[more].view(np.int64)), "fp_count": pa.array(whole.counts[more].astype(np.int64))})

    return filters.groupBy("slot_range").applyInArrow(merge, "fp long, fp_count long")


def exact_dedup(docs: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays. One row per row of
    ``docs``: doc_id, keep_id, group_size, kept, text_sha256. ``n_ranges`` (a power of
    two) tasks merge the filters."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("fp"))
    heavy = repeated_fingerprints(rows.select("fp"), n_ranges or range_count(docs))

    hashed = docs.select("doc_id", F.xxhash64(text).alias("fp"), F.sha2(text, 256).alias("text_sha256"))
    alone = hashed.join(heavy.select("fp"), "fp", "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")

    verify = rows.join(heavy.select("fp", F.ceil(F.col("fp_count") / SALT_ROWS).alias("salts")), "fp")
    classes = verify.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.max("salts").alias("salts"))
    classes = classes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    salted = verify.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), "salts").alias("salt"))
    # rows that repeat text and doc_id travel as one with their number
    times = salted.groupBy("text", "salt", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    copies = times.join(classes, ["text", "salt"]).select("doc_id", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256"), "times")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    copies = copies.withColumn("at", F.explode(F.expr(f"sequence(0L, (times - 1) div {SALT_ROWS})")))
    copies = copies.withColumn("turn", F.explode(F.expr(f"sequence(0L, least({SALT_ROWS}L, times - at * {SALT_ROWS}) - 1)")))
    copies = copies.withColumn("kept", stays & (F.col("at") == 0) & (F.col("turn") == 0))
    return alone.unionByName(copies.select(alone.columns))


def keep_one(docs: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``exact_dedup`` keeps: whole rows
    meet the repeated fingerprints once, and only copies are grouped by their text (each
    partition sends one row of a group at most)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(text).alias("fp"))
    heavy = repeated_fingerprints(docs.select(F.xxhash64(text)), n_ranges or range_count(docs))
    met = rows.join(heavy, "fp", "left")
    order = F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(1 << 63)))
    copies = met.where("fp_count is not null").groupBy(F.coalesce("row.text", F.lit("")).alias("t")).agg(F.max_by("row", order).alias("row"))
    return met.where("fp_count is null").select("row.*").unionByName(copies.select("row.*"))
