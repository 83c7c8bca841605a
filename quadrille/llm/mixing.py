"""Mixing sources to target weights by Pfair scheduling (operator 10, DataFrame
functions only).

Each source's rows form blocks of ``block_rows``. With ``share`` of the ``period``
slots, the j-th block of a source (from 0) is released at slot floor(j*period/share)
and due before slot ceil((j+1)*period/share); each slot takes the released block due
first (ties: the first source). Shares fill the period exactly, so every block runs
within its window and, after any slot, each source has had its share times the slots to
within less than one block. Windows repeat with the period, so one period is scheduled -
by one fold over its slots in one row of constants - and block b of a source takes its slot
b mod share in period b div share. A source that ran out leaves its slots empty.

Scale: a row's place in its source is a count of the rows in lower hash ranges plus its
rank in its own: the source is never gathered, however large, and ranges grow in number
with the input (``range_digits``). The tables of counts have one row for each source and
hash range. The schedule has one row for each slot; its fold takes slots x sources steps in
one task, so sources are meant to be thousands at most.

Defined cases: a null source is a source of its own; rows are taken in the order of the MD5
of doc_id and the MD5 of their text (null as empty), which also spreads rows without ids or
of one id; only rows that repeat doc_id and text tie, and each gets its own place; a table
without a column text goes by doc_id alone; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.textops import text_bytes

#: Bytes of text that a hash range should hold, if all were of one source.
RANGE_BYTES = 256 << 20
#: Stands for a null source.
NO_SOURCE = "\u0001none"


def shares_by_temperature(counts: DataFrame, slots: int, alpha: float) -> DataFrame:
    """src, share: slots in proportion to rows**alpha, one at least. counts: src, n."""
    whole = F.sum(F.pow(F.col("n").cast("double"), F.lit(alpha))).over(Window.partitionBy(F.lit(1)))
    return counts.select("src", F.greatest(F.lit(1), F.floor(F.lit(float(slots)) * F.pow(F.col("n").cast("double"), F.lit(alpha)) / whole).cast("int")).alias("share"))


def schedule(shares: DataFrame) -> DataFrame:
    """src, share, turn (0.. share-1), slot, period: one period of the EDF schedule."""
    one = shares.agg(F.array_sort(F.collect_list(F.struct("src", "share"))).alias("s"), F.sum("share").cast("int").alias("period"))
    fold = """
      aggregate(
        sequence(1, period),
        named_struct('done', transform(s, x -> 0), 'out', cast(array() as array<struct<slot: int, i: int, turn: int>>)),
        (a, t) -> aggregate(
          array(array_min(transform(
            filter(sequence(0, size(s) - 1), i -> cast(a.done[i] as bigint) * period < cast(s[i].share as bigint) * t and a.done[i] < s[i].share),
            i -> named_struct('due', (cast(a.done[i] + 1 as bigint) * period + s[i].share - 1) div s[i].share, 'i', i)))),
          a,
          (b, m) -> named_struct(
            'done', transform(b.done, (d, i) -> if(i = m.i, d + 1, d)),
            'out', concat(b.out, array(named_struct('slot', t - 1, 'i', m.i, 'turn', b.done[m.i]))))),
        a -> a.out)
    """
    planned = one.where("period > 0").select("s", "period", F.explode(F.expr(fold)).alias("e"))
    return planned.select(F.expr("s[e.i].src").alias("src"), F.expr("s[e.i].share").alias("share"), F.col("e.turn").alias("turn"), F.col("e.slot").alias("slot"), "period")


def range_digits(docs: DataFrame) -> int:
    """Hex digits of a key that make a range: 256 ranges at least."""
    ranges, digits = text_bytes(docs) // RANGE_BYTES, 2
    while 16**digits < ranges:
        digits += 1
    return digits


def mix_sources(docs: DataFrame, weights: dict[str, int] | None = None, block_rows: int = 16, slots: int = 256, alpha: float = 0.5, digits: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, block (of its source), slot and
    mix_position, by which the mixture is read; ``carry`` names further columns to keep.

    weights: slots a period for each source (a source that is not named gets one);
    without them, slots in proportion to rows**alpha. ``digits`` hex digits of the rows'
    keys (16**digits ranges) split a source; without them, ``range_digits``.
    """
    parts = [F.coalesce(F.col("doc_id").cast("string"), F.lit(""))]
    if "text" in docs.columns:
        parts.append(F.md5(F.coalesce("text", F.lit(""))))
        digits = digits or range_digits(docs)
    digits = digits or 2
    key = F.md5(F.concat_ws(" ", *parts))
    rows = docs.select("doc_id", "source", *carry, F.coalesce("source", F.lit(NO_SOURCE)).alias("__src"), key.alias("__key"), F.substring(key, 1, digits).alias("__range"))

    sizes = docs.select(F.coalesce("source", F.lit(NO_SOURCE)).alias("__src"), F.substring(key, 1, digits).alias("__range")).groupBy("__src", "__range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__src", "__range", F.coalesce(F.sum("n").over(Window.partitionBy("__src").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    counts = sizes.groupBy(F.col("__src").alias("src")).agg(F.sum("n").alias("n"))
    if weights is None:
        shares = shares_by_temperature(counts, slots, alpha)
    else:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        shares = counts.select("src", F.coalesce(F.try_element_at(table, F.col("src")), F.lit(1)).cast("int").alias("share"))
    plan = schedule(shares)
    share = plan.where("turn = 0").select(F.col("src").alias("__src"), "share", "period")

    rank = F.row_number().over(Window.partitionBy("__src", "__range").orderBy("__key"))
    placed = rows.withColumn("__rank", rank).join(before.join(share, "__src"), ["__src", "__range"]).withColumn("__at", F.col("__before") + F.col("__rank") - 1)
    placed = placed.withColumn("block", F.expr(f"__at div {int(block_rows)}")).withColumn("__turn", (F.col("block") % F.col("share")).cast("int"))
    slot_of = plan.select(F.col("src").alias("__src"), F.col("turn").alias("__turn"), "slot")
    placed = placed.join(slot_of, ["__src", "__turn"])
    slot = F.expr("(block div share) * period + slot")
    return placed.select("doc_id", "source", *carry, "block", slot.alias("slot"), (slot * int(block_rows) + F.col("__at") % int(block_rows)).alias("mix_position"))


def in_mixed_order(mixed: DataFrame) -> DataFrame:
    """The rows range-partitioned and sorted by mix_position: written as Parquet, the
    files in the order of their names hold the mixture."""
    return mixed.orderBy("mix_position")

