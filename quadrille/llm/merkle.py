"""Document fingerprints: Merkle trees over sections and paragraphs (operator 9).

A text is cut without loss: blank lines close sections, line ends close paragraphs,
sentence ends close the leaves of a paragraph. A leaf over ``MOST`` characters is cut on,
whatever the text's length: where a hash of the last ``WINDOW`` characters is picked, at
``LEAST`` characters or more, and where none is by ``MOST``, at the least hash up to there.
So leaves are bounded and an edit moves only the cuts near it, in any text.
A node's digest covers its children's digests in order, the root's also the length; the
root is the fingerprint, so equal roots mean equal texts.

Two trees are compared from the root down, in order: equal branches are aligned (``aligned``)
and count whole, only what lies between them is opened, down to the characters of differing
leaves, of which the equal first and last ones count. What is left are the edits, spans of
either text; all other characters are shared and give the likeness,
2 * shared / (length + length). A branch that moved past another one is an edit.

``fingerprint_with_next`` compares each document with an edited copy and with its
neighbour in descending doc_id. Documents are dealt to ranges of doc_id, and the first
document of each range also to the range that comes before it, so each range is one sorted
pass, no task holds more than two documents, and the text crosses the network once.

Defined cases: null text counts as empty; two empty texts have likeness 1, an empty and
another 0; a null doc_id comes last; rows of one doc_id (or of none) go by descending
SHA-256 of their text; a single document is its own neighbour.
"""

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.exchange import block_count, ranged
from quadrille.llm.textops import sha256_hex

MOST, LEAST, PICK, WINDOW = 64, 8, 16, 8
_SECTION = re.compile(r"(?:\n[ \t\r]*){2,}")
_LEAF = re.compile(r"[^.!?\n]*(?:[.!?]+[ \t]*|\n|$)")
_LINE = re.compile(r"[^\n]*\n|[^\n]+")
_FACTOR = 0x9E3779B97F4A7C15
_NO_ID = -(1 << 63)


def _rolling(text: str) -> np.ndarray:
    """Per position, a hash of the ``WINDOW`` (a power of two) characters before it, fewer
    at the start; of ``WINDOW`` or more characters."""
    total = np.zeros(len(text) + 1, np.uint64)
    total[1:] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    total[1:] += np.uint64(1)
    back = 1
    while back < WINDOW:
        total[back:] += total[:-back] * np.uint64(pow(_FACTOR, back, 1 << 64))
        back *= 2
    return (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)


def _leaves(paragraph: str) -> list[str]:
    out, hashes, at = [], None, 0
    for leaf in _LEAF.findall(paragraph):
        start, at = at, at + len(leaf)
        if at - start > MOST and hashes is None:
            hashes = _rolling(paragraph)
            picks, k = np.flatnonzero(hashes % np.uint64(PICK) == 0).tolist(), 0
        while at - start > MOST:  # LEAST >= WINDOW: only the leaf's own characters count
            k = bisect_left(picks, start + LEAST, k)
            if k < len(picks) and picks[k] <= start + MOST:
                end = picks[k]
            else:
                end = start + LEAST + int(hashes[start + LEAST : start + MOST + 1].argmin())
            out.append(paragraph[start:end])
            start = end
        if start < at:
            out.append(paragraph[start:at])
    return out


def _digest(kind: bytes, children: list[bytes]) -> bytes:
    return hashlib.sha256(kind + b"".join(children)).digest()[:16]


class Tree:
    """text; sections: (digest, characters, paragraphs); paragraphs: (digest, characters,
    leaves); leaves: (digest, characters). ``lines``: the paragraph of each line, which
    trees of similar texts (``like``) needn't make again."""

    __slots__ = ("lines", "root", "sections", "size", "text")

    def __init__(self, text: str, *like: "Tree"):
        self.size, self.sections, self.text, self.lines = len(text), [], text, {}
        start, cuts = 0, [m.end() for m in _SECTION.finditer(text)]
        for end in [*cuts, len(text)]:
            if end > start:
                paragraphs = [self._paragraph(line, like) for line in _LINE.findall(text[start:end])]
                self.sections.append((_digest(b"S", [p[0] for p in paragraphs]), end - start, paragraphs))
            start = end
        self.root = hashlib.sha256(b"R%d:" % self.size + b"".join(s[0] for s in self.sections)).hexdigest()

    def _paragraph(self, line: str, like: tuple):
        for tree in (self, *like):
            if (found := tree.lines.get(line)) is not None:
                return found
        leaves = [(hashlib.blake2b(x.encode(), digest_size=16).digest(), len(x)) for x in _leaves(line)]
        found = self.lines[line] = _digest(b"P", [d for d, _ in leaves]), len(line), leaves
        return found


def _rising(places: list[int]) -> list[int]:
    """Indexes of a longest rising run of distinct numbers."""
    tops: list[int] = []  # least last number of a run of each length, and its index
    last: list[int] = []
    before = [-1] * len(places)
    for i, x in enumerate(places):
        k = bisect_left(tops, x)
        if k == len(tops):
            tops.append(x)
            last.append(i)
        else:
            tops[k], last[k] = x, i
        before[i] = last[k - 1] if k else -1
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def aligned(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Pairs of places of equal digests, rising in both lists: the common head and tail,
    and between them a longest rising run in which the k-th occurrence of a digest meets
    the k-th."""
    most, head, tail = min(len(a), len(b)), 0, 0
    while head < most and a[head] == b[head]:
        head += 1
    while tail < most - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    pairs = [(i, i) for i in range(head)]
    if head + tail < most and (both := set(a[head : len(a) - tail]).intersection(b[head : len(b) - tail])):
        places = {x: [] for x in both}
        for j in range(len(b) - tail - 1, head - 1, -1):
            if b[j] in both:
                places[b[j]].append(j)
        met = []
        for i in range(head, len(a) - tail):
            if a[i] in both and places[a[i]]:
                met.append((i, places[a[i]].pop()))
        pairs += [met[k] for k in _rising([j for _, j in met])]
    return pairs + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def _same(a: str, b: str, most: int, part) -> int:
    low = 0
    while low < most:
        half = (low + most + 1) // 2
        low, most = (half, most) if part(a, half) == part(b, half) else (low, half - 1)
    return low


def edits(a: "Tree", b: "Tree") -> list[tuple[int, int, int, int]]:
    """What differs, in order: (start, end) in ``a`` that stands for (start, end) in ``b``."""
    if a.root == b.root:
        return []
    out: list[tuple[int, int, int, int]] = []

    def open_(xs: list, x: int, ys: list, y: int, level: int) -> None:
        i = j = 0
        for p, q in [*aligned([n[0] for n in xs], [n[0] for n in ys]), (len(xs), len(ys))]:
            if i == p and j == q and p < len(xs):  # nothing between two equal branches
                x, y, i, j = x + xs[p][1], y + ys[q][1], p + 1, q + 1
                continue
            x_end, y_end = x + sum([n[1] for n in xs[i:p]]), y + sum([n[1] for n in ys[j:q]])
            if x < x_end and y < y_end and level < 2:
                open_([c for n in xs[i:p] for c in n[2]], x, [c for n in ys[j:q] for c in n[2]], y, level + 1)
            elif x < x_end or y < y_end:
                one, two = a.text[x:x_end], b.text[y:y_end]
                most = min(len(one), len(two))
                head = _same(one, two, most, lambda t, n: t[:n])
                tail = _same(one, two, most - head, lambda t, n: t[len(t) - n :])
                if len(one) + len(two) > 2 * (head + tail):
                    out.append((x + head, x_end - tail, y + head, y_end - tail))
            i, j = p + 1, q + 1
            if p < len(xs):
                x, y = x_end + xs[p][1], y_end + ys[q][1]

    open_(a.sections, 0, b.sections, 0, 0)
    return out


def likeness(a: "Tree", b: "Tree", found: list | None = None) -> float:
    """0 to 1; found: the ``edits`` of the two, where they are known."""
    if a.root == b.root:
        return 1.0
    if not a.size or not b.size:
        return 0.0
    found = edits(a, b) if found is None else found
    return 1.0 - sum(e - s + f - t for s, e, t, f in found) / (a.size + b.size)


def edited(text: str, after: str) -> str:
    """The last third of ``text`` replaced by as many first characters of ``after``."""
    m = len(text) // 3
    return text[: len(text) - m] + after[:m]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every row: a map-only scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([Tree(t).root for t in texts], pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


PAIR_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edits array<struct<start: long, length: long>>"
_EDITS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
_PAIR_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edits", _EDITS)])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range, the neighbour range's first document last in each."""
    before, at = None, None
    for whole in batches:
        out: list[list] = [[] for _ in _PAIR_ARROW]
        for block, ghost, doc_id, text in zip(*(c.to_pylist() for c in whole.columns), strict=True):
            if block != at:
                before, at = None, block
            text = text or ""
            tree = Tree(text)
            if before is not None:
                old_id, old, old_tree = before
                new = edited(old, text)
                new_tree = Tree(new, old_tree, tree)
                found = edits(old_tree, new_tree)
                spans = [{"start": s, "length": e - s} for s, e, _, _ in found]
                for column, value in zip(out, (old_id, len(old), sha256_hex(new.encode()), old_tree.root, new_tree.root, likeness(old_tree, new_tree, found), likeness(old_tree, tree), spans), strict=True):
                    column.append(value)
            before = None if ghost else (doc_id, text, tree)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PAIR_ARROW, strict=True)], schema=_PAIR_ARROW)


def fingerprint_with_next(docs: DataFrame, block_bytes: int | None = None) -> DataFrame:
    """One row per row of ``docs``, as PAIR_SCHEMA; edits: the spans of the document that
    its edited text doesn't have."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = ranged(src, block_count(src, block_bytes)[1])  # a task streams its ranges
    dealt = dealt.withColumn("k", F.coalesce("doc_id", F.lit(_NO_ID))).withColumn("sha", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    # of each range the first document, for the range before it in descending doc_id
    firsts = dealt.groupBy("block").agg(F.max(F.struct("k", "sha")).alias("top"))
    later = Window.orderBy("block")  # a row a range
    to = firsts.select("top", F.coalesce(F.lead("block").over(later), F.min("block").over(Window.partitionBy(F.lit(1)))).alias("to"))
    # a row a range: they grow with the square root of the input (220,000 for 100 TB)
    ghosts = dealt.join(F.broadcast(to.select(F.col("top.k").alias("k"), F.col("top.sha").alias("sha"), "to")), ["k", "sha"]).dropDuplicates(["to"])
    rows = dealt.select("block", F.lit(False).alias("ghost"), "doc_id", "text", "k", "sha").unionByName(ghosts.select(F.col("to").alias("block"), F.lit(True).alias("ghost"), "doc_id", "text", "k", "sha"))
    ordered = rows.repartition("block").sortWithinPartitions("block", "ghost", F.desc("k"), F.desc("sha"))
    return ordered.select("block", "ghost", "doc_id", "text").mapInArrow(_pairs, PAIR_SCHEMA)
