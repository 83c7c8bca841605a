"""Path operators over an edge frame (s, p, o): frontier joins, one shuffle or two a round.

Each round joins the frontier with the edges, keeps the least path to each newly reached
(root, node) and drops what was visited. A search starts from the side of the pairs that has
fewer nodes - a constant end is one - and a root is left as soon as all its pairs are found.
Lengths and booleans carry no paths. Each round is checkpointed on its own, so a lost
executor costs one round and nothing is written twice; nothing but counts reaches the driver.
A path is an array of terms [node, predicate, node, ...]; among shortest paths the least
array is taken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.lineage import cut


def both_ways(edges: DataFrame, directed: bool) -> DataFrame:
    edges = edges.select("s", "p", "o")
    return edges if directed else edges.union(edges.select(F.col("o").alias("s"), "p", F.col("s").alias("o")))


# Terms up to which a frontier is sent whole to where the edges are, so that those needn't be shuffled.
_FEW = 200_000


def _small(df: DataFrame, terms: int) -> DataFrame:
    return F.broadcast(df) if terms <= _FEW else df


def _any(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def shortest(pairs: DataFrame, edges: DataFrame, k: int | None = None, paths: bool = True) -> DataFrame:
    """src, dst, depth (and path) of the pairs that are connected, in k hops at most; a pair
    of one node has depth 0."""
    pairs = cut(pairs.distinct())
    sizes = pairs.agg(F.count_distinct("src"), F.count_distinct("dst")).first()
    ahead = sizes[0] <= sizes[1]
    root, goal, near, far = ("src", "dst", "s", "o") if ahead else ("dst", "src", "o", "s")
    left = pairs.select(F.col(root).alias("root"), F.col(goal).alias("goal"))
    links = edges.select(F.col(near).alias("node"), F.col(far).alias("to"), "p")
    if not paths:
        links = links.select("node", "to")
    keep = ["root", "node", *(["path"] if paths else [])]
    front = cut(left.select("root").distinct().select("root", F.col("root").alias("node"), F.array("root").alias("path")).select(keep))
    rounds, found, depth = [front], [], 0
    size = seen = min(sizes)
    while True:
        width = 2 * depth + 2 if paths else 2
        front = _small(front, size * width)
        met = cut(left.join(front.withColumnRenamed("node", "goal"), ["root", "goal"]).withColumn("depth", F.lit(depth)))
        if not met.isEmpty():
            found.append(met)
            left = cut(left.join(met, ["root", "goal"], "left_anti"))
            if left.isEmpty():
                break
        if depth == k:
            break
        depth += 1
        roots = _small(left.select("root").distinct(), min(sizes))
        live = _small(front.join(roots, "root", "left_semi"), size * width) if found and min(sizes) > 1 else front
        step = live.join(links, "node")
        if paths:
            way = F.concat("path", F.array("p", "to")) if ahead else F.concat(F.array("to", "p"), "path")
            fresh = step.select("root", F.col("to").alias("node"), way.alias("path")).groupBy("root", "node").agg(F.min("path").alias("path"))
        else:
            fresh = step.select("root", F.col("to").alias("node")).distinct()
        visited = _small(_any([r.select("root", "node") for r in rounds]), 2 * seen)
        front = cut(fresh.join(visited, ["root", "node"], "left_anti"))
        if not (size := front.count()):
            break
        seen += size
        rounds.append(front)
    got = _any(found) if found else met
    return got.withColumnsRenamed({"root": root, "goal": goal})


def cycles(pairs: DataFrame, edges: DataFrame, directed: bool, paths: bool = True) -> DataFrame:
    """src, dst (and path there and back); a pair of one node has none."""
    pairs = pairs.where("src <> dst").distinct()
    there = shortest(pairs, edges, None, paths)
    if not paths:
        there = there.select("src", "dst")
        if not directed:
            return there
        back = shortest(there.select(F.col("dst").alias("src"), F.col("src").alias("dst")), edges, None, False)
        return back.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    there = there.select("src", "dst", "path")
    if directed:
        back = shortest(there.select(F.col("dst").alias("src"), F.col("src").alias("dst")), edges)
        back = back.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("path").alias("back"))
    else:
        back = there.select("src", "dst", F.reverse("path").alias("back"))
    return there.join(back, ["src", "dst"]).select("src", "dst", F.concat("path", F.slice("back", F.lit(2), F.size("back"))).alias("path"))


def _further(front: DataFrame, edges: DataFrame) -> DataFrame:
    """src, node, path of the paths of ``front`` and one hop more that repeat no node."""
    on = (front.node == edges.s) & ~F.array_contains(F.filter("path", lambda x, i: i % 2 == 0), F.col("o"))
    return cut(front.join(edges, on).select("src", F.col("o").alias("node"), F.concat("path", F.array("p", "o")).alias("path")))


def walks(pairs: DataFrame, edges: DataFrame, k: int | None) -> DataFrame:
    """src, dst, path of every path of 1 to k hops (of any number without k) that repeats
    no node."""
    sources = pairs.select("src").distinct()
    front = sources.select("src", F.col("src").alias("node"), F.array("src").alias("path"))
    out, hop = front.where(F.lit(False)), 0
    while k is None or hop < k:
        hop += 1
        front = _further(front, edges)
        if front.isEmpty():
            break
        out = out.union(front)
    return pairs.distinct().join(out.withColumnRenamed("node", "dst"), ["src", "dst"])


def simple_cycles(pairs: DataFrame, edges: DataFrame, k: int | None) -> DataFrame:
    """src, dst, path: the shortest cycle from src through dst that repeats no node (least
    of equal ones), of at most k hops (of any number without k). Sources whose pairs all
    have their cycle are followed no further."""
    left = cut(pairs.where("src <> dst").distinct())
    front = left.select("src").distinct().select("src", F.col("src").alias("node"), F.array("src").alias("path"))
    out, hop = left.select("src", "dst", F.array("src").alias("path")).where(F.lit(False)), 0
    while k is None or hop < k:
        hop += 1
        ends = front.join(edges, (front.node == edges.s) & (F.col("o") == F.col("src"))).select("src", F.concat("path", F.array("p", "o")).alias("path"))
        if hop == 2:  # there and back over one edge is no simple cycle
            ends = ends.where(F.col("path")[1] != F.col("path")[3])
        if hop > 1:
            through = left.join(ends, "src").where(F.array_contains(F.filter("path", lambda x, i: i % 2 == 0), F.col("dst")))
            found = cut(through.groupBy("src", "dst").agg(F.min("path").alias("path")))
            if not found.isEmpty():
                out = out.union(found)
                left = cut(left.join(found, ["src", "dst"], "left_anti"))
                front = front.join(left.select("src").distinct(), "src", "left_semi")
        front = _further(front, edges)
        if front.isEmpty():
            break
    return out


def path_call(name: str, pairs: DataFrame, edges: DataFrame, directed: bool, k: int | None) -> tuple[DataFrame, str]:
    """src, dst, value of a call for each pair, and the value's kind. Booleans and lengths
    of unconnected pairs are absent (false and null after a left join)."""
    edges = both_ways(edges, directed)
    if name in ("simplecyclepath", "simplecycleboolean", "khopenumerate"):
        edges = edges.distinct()
    bound = k if k is not None and k >= 0 else None
    if name in ("cyclepath", "cycleboolean"):
        got = cycles(pairs, edges, directed, name == "cyclepath")
    elif name in ("simplecyclepath", "simplecycleboolean"):
        got = simple_cycles(pairs, edges, bound)
    elif name == "khopenumerate":
        got = walks(pairs, edges, bound)
    else:
        got = shortest(pairs, edges, bound if name == "khopreachable" else None, name == "shortestpath")
    if name == "shortestpathlen":
        return got.select("src", "dst", F.col("depth").cast("long").alias("value")), "int"
    if name in ("cycleboolean", "simplecycleboolean", "khopreachable"):
        return got.select("src", "dst", F.lit(True).alias("value")), "bool"
    return got.select("src", "dst", F.array_join("path", " ").alias("value")), "str"


def closure(pairs: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """s, o connected by one or more of ``pairs`` (s, o); only from the nodes ``start`` (n)."""
    pairs = cut(pairs.distinct())
    front = pairs if start is None else cut(pairs.join(start, pairs.s == start.n, "left_semi"))
    rounds = [front]
    while True:
        step = front.select("s", F.col("o").alias("mid")).join(pairs.select(F.col("s").alias("mid"), "o"), "mid").select("s", "o").distinct()
        front = cut(step.join(_any(rounds), ["s", "o"], "left_anti"))
        if front.isEmpty():
            return _any(rounds)
        rounds.append(front)


def hop_stats(edges: DataFrame, numbers: DataFrame, hops: int = 2) -> DataFrame:
    """v, p, hop, lo, hi: bounds of each numeric predicate's value reachable in exactly
    1..hops edges (hop 0: the node's own). numbers: s, p, value."""
    now = cut(numbers.groupBy(F.col("s").alias("v"), "p").agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    out = now.withColumn("hop", F.lit(0))
    links = edges.select(F.col("s").alias("from"), F.col("o").alias("v")).distinct()
    for hop in range(1, hops + 1):
        now = cut(links.join(now, "v").groupBy(F.col("from").alias("v"), "p").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
        out = out.unionByName(now.withColumn("hop", F.lit(hop)))
    return out
