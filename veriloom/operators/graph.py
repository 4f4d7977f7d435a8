"""Sentence graphs: kNN links, PageRank, hops and betweenness."""

from __future__ import annotations

from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairs import blocked_join, nearest, top_per_row
from .storage import checkpointed


def knn_graph(rows: DataFrame, k: int) -> DataFrame:
    """(src, dst, weight) in both directions for rows (id, grp, v): the k nearest of each, at least 1e-6 heavy."""
    near = top_per_row(nearest(rows, rows, k), k)
    weight = F.greatest(F.col("sim"), F.lit(1e-6))
    both = near.select(F.col("a").alias("src"), F.col("b").alias("dst"), weight.alias("weight")).unionByName(near.select(F.col("b").alias("src"), F.col("a").alias("dst"), weight.alias("weight")))
    return both.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, rank) by a fixed number of rounds over weighted directed edges; every node has an edge."""
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    shares = edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")).persist()
    n = out.count()
    rank = out.select(F.col("src").alias("node"), F.lit(1.0 / n).alias("rank"))
    for i in range(rounds):
        rank = shares.join(rank, shares["src"] == rank["node"]).groupBy(F.col("dst").alias("node")).agg((F.lit((1 - damping) / n) + damping * F.sum(F.col("rank") * F.col("share"))).alias("rank"))
        rank = checkpointed(rank) if i % 5 == 4 or i == rounds - 1 else rank
    shares.unpersist()
    return rank


def dense_graph(rows: DataFrame, floor: float = 0.1) -> DataFrame:
    """(src, dst, weight) in both directions for all pairs of rows (id, grp, v) at least ``floor`` similar."""
    near = blocked_join(rows, rows, floor, same_group=None)
    return near.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("sim").alias("weight"))


def hops(edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """(node, hops): fewest links from any seed (node), up to ``most``."""
    known = frontier = seeds.select("node", F.lit(0).alias("hops")).distinct()
    for i in range(1, most + 1):
        reached = edges.join(frontier, edges["src"] == frontier["node"]).select(F.col("dst").alias("node"), F.lit(i).alias("hops")).distinct()
        frontier = checkpointed(reached.join(known.select("node"), "node", "left_anti"))
        known = known.unionByName(frontier)
    return known


def path_lengths(edges: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    """(seed, node, length): the shortest weighted path of up to ``rounds`` links from each seed (node); a link is 1 - weight long, 0 at least."""
    steps = edges.select("src", F.col("dst").alias("to"), F.greatest(F.lit(0.0), 1 - F.col("weight")).alias("step"))
    known = frontier = seeds.select(F.col("node").alias("seed"), "node", F.lit(0.0).alias("length")).distinct()
    for _ in range(rounds):
        reached = frontier.join(steps, frontier["node"] == steps["src"]).select("seed", F.col("to").alias("node"), (F.col("length") + F.col("step")).alias("length")).groupBy("seed", "node").agg(F.min("length").alias("length"))
        best = reached.join(known.withColumnRenamed("length", "was"), ["seed", "node"], "left").where("was IS NULL OR length < was")
        frontier = checkpointed(best.select("seed", "node", "length"))
        known = checkpointed(known.unionByName(frontier).groupBy("seed", "node").agg(F.min("length").alias("length")))
    return known


def neighbour_jaccard(edges: DataFrame) -> DataFrame:
    """(a, b, jaccard) of the neighbour sets of linked nodes."""
    near = edges.groupBy("src").agg(F.collect_set("dst").alias("near"))
    both = edges.where("src < dst").join(near.withColumnRenamed("near", "x"), "src").join(near.select(F.col("src").alias("dst"), F.col("near").alias("y")), "dst")
    return both.select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("jaccard"))


#: Source nodes that one task finds shortest paths from, each with the edges of the whole graph.
SOURCES = 256


def betweenness(edges: DataFrame, graph: str = "graph_id", length: str | None = None, normalized: bool = False) -> DataFrame:
    """(graph_id, node, betweenness) of undirected graphs (graph_id, src, dst[, length]): the share of shortest paths that pass a node.

    A graph's source nodes are dealt out in blocks, each with a copy of the graph's edges, and Spark adds up what
    the blocks find, so a large graph is many tasks.  Without ``length`` every edge is one step; lengths of 0 and less count as 1e-12, and the
    shortest of repeated edges counts.  ``normalized`` divides by the pairs of other nodes, where there are any.
    """
    links = edges.select(graph, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), (F.greatest(F.col(length).cast("double"), F.lit(1e-12)) if length else F.lit(1.0)).alias("length"))
    links = links.where("src <> dst").groupBy(graph, "src", "dst").agg(F.min("length").alias("length"))
    nodes = links.select(graph, F.explode(F.array("src", "dst")).alias("node")).distinct()
    sizes = nodes.groupBy(graph).agg(F.count("*").alias("nodes"))
    dealt = sizes.withColumn("blocks", F.ceil(F.col("nodes") / SOURCES).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    kind = edges.schema[graph].dataType.simpleString()

    def measure(frame: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b, step in zip(frame["src"].tolist(), frame["dst"].tolist(), frame["length"].tolist(), strict=True):
            near.setdefault(a, []).append((b, step))
            near.setdefault(b, []).append((a, step))
        score = dict.fromkeys(near, 0.0)
        for s in sorted(near)[frame["block"].iloc[0] :: frame["blocks"].iloc[0]]:
            order, paths, before = _shortest(near, s)
            carried = dict.fromkeys(order, 0.0)
            for y in reversed(order):
                for x in before[y]:
                    carried[x] += paths[x] / paths[y] * (1 + carried[y])
                if y != s:
                    score[y] += carried[y]
        return pd.DataFrame({graph: frame[graph].iloc[0], "node": list(score), "part": list(score.values())})

    parts = links.join(dealt.drop("nodes"), graph).groupBy(graph, "block").applyInPandas(measure, f"{graph} {kind}, node long, part double")
    n = F.col("nodes")
    others = F.when(n > 2, (n - 1) * (n - 2)).otherwise(2) if normalized else F.lit(2)
    return parts.groupBy(graph, "node").agg(F.sum("part").alias("part")).join(sizes, graph).select(graph, "node", (F.col("part") / others).alias("betweenness"))


def _shortest(near: dict, source) -> tuple[list, dict, dict]:
    """Nodes by their distance from a source, how many shortest paths lead to each, and the nodes before it on those."""
    settled, order, paths, before, best = set(), [], {source: 1}, {source: []}, {source: 0.0}
    queue = [(0.0, source)]
    while queue:
        d, x = heappop(queue)
        if x in settled:
            continue
        settled.add(x)
        order.append(x)
        for y, step in near[x]:
            there = d + step
            if y not in best or there < best[y]:
                best[y], paths[y], before[y] = there, paths[x], [x]
                heappush(queue, (there, y))
            elif there == best[y] and y not in settled:
                paths[y] += paths[x]
                before[y].append(x)
    return order, paths, before
