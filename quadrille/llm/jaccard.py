"""N-gram Jaccard join by MinHash banding (operator 7).

Equal texts are one node. Each node's set of hashed ``shingle``-word n-grams gets a MinHash
signature cut into bands; bands and rows are chosen by ``bands_for`` for a target recall
at the threshold. Nodes shuffle on band hashes; those that share a bucket with its least
node join one candidate cluster (components of these stars), so a bucket costs a row a
member, never its pairs. Within a cluster every pair is verified on the full n-gram sets:
clusters are dealt to tasks, a large one in chunks that meet in pairs, and a task counts
intersections by matrix products and returns, for each node, the documents it links to,
and a spanning forest of the links; pairs are never emitted.

The result has one row a document: its class (component of verified links), the number of
other documents at or over the threshold, and the number of its exact copies.

Scale: signatures and buckets are some hundred bytes a document; text crosses the network
once to nodes in clusters and once for each chunk that a node's cluster has. A group of
exact copies is one node. Work within a cluster of m different texts grows with m**2 /
tasks, the number of pairs that have to be judged.

Defined cases: null text counts as empty; texts of fewer words than a shingle have no
n-grams and only link to equal texts; a null doc_id, or a doc_id given to several texts,
is replaced by a negative hash of the text in class ids; repeated rows are copies.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.components import components
from quadrille.llm.lineage import cut
from quadrille.llm.textops import U64, byte_chunks, give_back, mix, rolling, span_hashes, utf8_column, windows_in_docs, word_spans

#: Nodes of a chunk and n-grams of a chunk, at most (but for one longer document).
CHUNK_NODES, CHUNK_GRAMS = 256, 1 << 21


def bands_for(threshold: float, recall: float, most_rows: int = 6) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands reach ``recall`` at ``threshold``."""
    rows = most_rows
    bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
    return bands, rows


def _shingles(column, shingle: int):
    """Hashes of all n-grams and, per document, how many."""
    data, offsets = utf8_column(column)
    starts, ends, first = word_spans(data, offsets)
    at, count = windows_in_docs(first, shingle)
    grams = rolling(span_hashes(data, starts, ends), shingle)
    return (mix(grams[at]) if len(at) else np.zeros(0, U64)), count


def _signer(shingle: int, bands: int, rows: int):
    rng = np.random.default_rng(20240607)
    flip = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    factor = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    radix = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(rows)], dtype=U64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = utf8_column(batch.column(1))
            for a, b in byte_chunks(offsets, 1 << 19):
                part = batch.slice(a, b - a)
                grams, count = _shingles(part.column(1), shingle)
                low = (grams >> U64(32)).astype(np.uint32)
                have = np.flatnonzero(count)
                first = (np.cumsum(count) - count)[have]
                least = np.empty((bands * rows, len(have)), np.uint32)
                if len(have):
                    for j in range(bands * rows):
                        least[j] = np.minimum.reduceat((low ^ flip[j]) * factor[j], first)
                value = (least.reshape(bands, rows, -1).astype(U64) * radix[None, :, None]).sum(axis=1, dtype=U64)
                value = mix(value + (np.arange(bands, dtype=U64) * U64(0xA24BAED4963EE407))[:, None])
                offs = np.zeros(len(count) + 1, np.int32)
                offs[1:] = np.cumsum(np.where(count > 0, bands, 0))
                lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.ascontiguousarray(value.T).reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(count), lists], names=["doc_id", "sha", "n_grams", "bands"])
        give_back()

    return sign


def _links(sets: list[np.ndarray], side: np.ndarray, across: bool, threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold; of two sides where ``across``."""
    m = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, m)
    owner = np.repeat(np.arange(m), sizes)
    grams = np.concatenate(sets)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    new = np.concatenate([[True], grams[1:] != grams[:-1]])
    shared = ~(new & np.append(new[1:], True))  # of two sets and more
    column = np.cumsum(new[shared]) - 1 if shared.any() else np.zeros(0, np.int64)
    owner = owner[shared]
    both = np.zeros((m, m), np.float64)
    width = max(64, (1 << 21) // m)
    edge = np.searchsorted(column, np.arange(0, (int(column[-1]) + 1 if len(column) else 0) + width, width))
    for k in range(len(edge) - 1):
        a, b = edge[k], edge[k + 1]
        if a < b:
            dense = np.zeros((m, width), np.float32)
            dense[owner[a:b], column[a:b] - k * width] = 1
            both += dense @ dense.T
    union = sizes[:, None] + sizes[None, :] - both
    linked = both >= threshold * union - 1e-9
    linked[sizes == 0] = linked[:, sizes == 0] = False
    np.fill_diagonal(linked, False)
    if across:
        linked &= side[:, None] != side[None, :]
    return linked


def _forest(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    unseen = np.ones(len(linked), bool)
    for root in range(len(linked)):
        if not unseen[root]:
            continue
        unseen[root] = False
        todo = [root]
        while todo:
            at = todo.pop()
            fresh = np.flatnonzero(linked[at] & unseen)
            unseen[fresh] = False
            for x in fresh.tolist():
                yield at, x
                todo.append(x)


def _verifier(shingle: int, threshold: float):
    def judge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cluster", "ascending"), ("node", "ascending")])
        cluster, node, copies, side = (table[c].to_numpy() for c in ("cluster", "node", "copies", "side"))
        across = table["across"].to_pylist()
        keep = np.concatenate([[True], (cluster[1:] != cluster[:-1]) | (node[1:] != node[:-1])])
        text = table["text"].combine_chunks()
        a_out, b_out, links_out = [], [], []
        edge = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1], [True]]))
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            rows = np.arange(lo, hi)[keep[lo:hi]]
            if len(rows) < 2:
                continue
            grams, count = _shingles(text.take(pa.array(rows)), shingle)
            sets = [np.unique(x) for x in np.split(grams, np.cumsum(count)[:-1])]
            linked = _links(sets, side[rows], across[lo], threshold)
            total = linked @ copies[rows].astype(np.float64)
            for i in np.flatnonzero(total).tolist():
                a_out.append(int(node[rows[i]]))
                b_out.append(None)
                links_out.append(int(total[i]))
            for i, j in _forest(linked):
                a_out.append(int(node[rows[i]]))
                b_out.append(int(node[rows[j]]))
                links_out.append(0)
        return pa.table([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64()), pa.array(links_out, pa.int64())], names=["a", "b", "links"])

    def verify(table: pa.Table) -> pa.Table:
        found = judge(table)
        give_back()
        return found

    return verify


def _judge(docs: DataFrame, threshold: float, shingle: int, recall: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows with digests; texts as nodes; what the tasks found; node and root of each class."""
    bands, rows = bands_for(threshold, recall)
    text = F.coalesce("text", F.lit(""))
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("sha"))
    signed = hashed.mapInArrow(_signer(shingle, bands, rows), "doc_id long, sha binary, n_grams long, bands array<long>")
    texts = signed.groupBy("sha").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    stand_in = F.bitwise_not(F.shiftrightunsigned(F.xxhash64("sha"), 1))
    turn = F.row_number().over(Window.partitionBy(F.coalesce("rep", stand_in)).orderBy("sha"))  # null ids don't meet
    nodes = cut(texts.withColumn("node", F.when(F.col("rep").isNull() | (turn > 1), stand_in).otherwise(F.col("rep"))))

    exploded = nodes.select("node", F.explode("bands").alias("band"))
    buckets = exploded.groupBy("band").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "least")
    stars = exploded.join(buckets, "band").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    clusters = components(stars).withColumnRenamed("root", "cluster")

    members = cut(clusters.join(nodes.select("node", "rep", "sha", "copies", "n_grams"), "node"))
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum("n_grams").alias("grams"))
    sizes = sizes.select("cluster", F.greatest(F.ceil(F.col("m") / CHUNK_NODES), F.ceil(F.col("grams") / CHUNK_GRAMS)).alias("chunks"))
    bins = max(1, members.count() // CHUNK_NODES)
    dealt = members.join(sizes, "cluster").withColumn("side", F.pmod(F.xxhash64("node"), "chunks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    # a cluster of one chunk shares a task with others; of more, each pair of chunks has its own
    spread = dealt.withColumn("other", other).select(
        "node", "rep", "sha", "copies", "cluster", "side", (F.col("side") != F.col("other")).alias("across"),
        F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.xxhash64("cluster", F.least("side", "other"), F.greatest("side", "other"))).alias("task"),
    )
    wanted = members.select("sha", "rep")
    whole = hashed.join(wanted, (hashed.sha == wanted.sha) & hashed.doc_id.eqNullSafe(wanted.rep), "left_semi").select("sha", "text")
    units = spread.join(whole, "sha").select("task", "node", "copies", "cluster", "side", "across", "text")
    found = cut(units.groupBy("task").applyInArrow(_verifier(shingle, threshold), "a long, b long, links long"))

    return hashed, nodes, found, components(found.where("b is not null").select("a", "b"))


def ngram_jaccard(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, recall: float = 0.9995) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the class's least doc_id), n_links
    (other documents whose n-gram sets reach ``threshold``, or whose texts are equal) and
    n_copies (documents of this very text)."""
    hashed, nodes, found, classes = _judge(docs, threshold, shingle, recall)
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    judged = nodes.select("sha", "node", "copies").join(classes, "node", "left").join(links, "node", "left")
    judged = judged.select("sha", F.coalesce("root", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    return hashed.select("doc_id", "sha").join(judged, "sha").select("doc_id", "class_id", "n_links", "n_copies")


def keep_apart(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, recall: float = 0.9995) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class the text of the least node
    stays (see class_id above), and of its rows those with its least doc_id. Rows go by
    their texts, so null, negative and repeated doc_ids are like any other."""
    _, nodes, _, classes = _judge(docs, threshold, shingle, recall)
    texts = nodes.select("node", "sha", "rep", "copies").join(classes, "node", "left")
    marks = texts.select(F.col("sha").alias("__sha"), F.col("rep").alias("__rep"), "copies", (F.coalesce("root", "node") != F.col("node")).alias("__gone"))
    marks = marks.where("__gone or copies > 1").select("__sha", "__rep", "__gone")
    other = ~F.col("__id").eqNullSafe(F.col("__rep"))
    rows = docs.select("*", F.col("doc_id").cast("long").alias("__id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("__digest"))
    return rows.join(marks, (F.col("__digest") == F.col("__sha")) & (F.col("__gone") | other), "left_anti").select(docs.columns)
