"""Ranks from walks: global and personalized, by exact expectation, and their distance."""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from walkgraph.config import WalkConfig
from walkgraph.errors import EmptyWalkStore, InvalidTopK, NodeNotInWalk
from walkgraph.functions import rng
from walkgraph.operators import walkstore
from walkgraph.operators.graph import GraphStore
from walkgraph.operators.walks import adjacency, grow_by_join, is_small
from walkgraph.sources.state import kept

#: The salt of walks that are made for one answer.
FRESH = 5


def global_rank(walks: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(node, score): visits of each node over the visits of all nodes, also if only some are asked for."""
    total = walkstore.total_visits(walks).first()[0]
    if total == 0:
        raise EmptyWalkStore
    return walkstore.visit_counts(walks, ids).select("node", (F.col("visits") / F.lit(total)).alias("score"))


def frequencies(sequence: DataFrame) -> DataFrame:
    """(node, score) of a table (node) of visits."""
    n = sequence.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n")).first()[0]
    return n.select("node", (F.col("n") / F.lit(total or 1)).alias("score"))


def distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sum of differences over the nodes of the first."""
    other = b.select("node", F.col("score").alias("__b"))
    return a.join(other, "node", "left").agg(F.coalesce(F.sum(F.abs(F.col("score") - F.coalesce("__b", F.lit(0.0)))), F.lit(0.0)).alias("distance"))


def top(ranks: DataFrame, k: int) -> DataFrame:
    return ranks.orderBy(F.desc("score"), "node").limit(k)


def required_length(top_k: int, alpha: float) -> int:
    """How long a personalized walk has to be for a good order of the first top_k nodes."""
    return round(100 / (1 - alpha) * top_k**alpha * (10**7) ** (1 - alpha))


def walks_needed(length: int, alpha: float) -> int:
    return int(np.float32(length) * np.float32(1 - alpha))


def exact(nodes: DataFrame, edges: DataFrame, alpha: float, sources: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(node, score), the expectation of self-avoiding walks from all nodes, or from sources (id).

    Paths are enumerated step by step with their probabilities until none is left, so this is for
    small or acyclic graphs. With max_depth, an error if paths of more nodes are left."""
    edges = edges.select("src", "dst").distinct()
    degree = edges.groupBy(F.col("src").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    out = kept(edges.join(degree, F.col("src") == F.col("s")).select("src", "dst", (F.lit(alpha) / F.col("n")).alias("p")))
    paths = kept((nodes if sources is None else sources).select(F.array("id").alias("path"), F.lit(1.0).alias("w")))
    totals, depth = [], 0
    while not paths.isEmpty():
        depth += 1
        if max_depth is not None and depth > max_depth:
            raise ValueError(f"paths of more than {max_depth} nodes are left")
        totals.append(paths.groupBy(F.element_at("path", -1).alias("node")).agg(F.sum("w").alias("w")))
        paths = paths.join(out, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        paths = kept(paths.select(F.concat("path", F.array("dst")).alias("path"), (F.col("w") * F.col("p")).alias("w")))
    if not totals:
        return nodes.select(F.col("id").alias("node"), F.lit(0.0).alias("score"))
    every = totals[0]
    for t in totals[1:]:
        every = every.unionByName(t)
    every = kept(every.groupBy("node").agg(F.sum("w").alias("w")))
    total = every.agg(F.sum("w")).first()[0]
    return nodes.select(F.col("id").alias("node")).join(every, "node", "left").select("node", (F.coalesce("w", F.lit(0.0)) / F.lit(total)).alias("score"))


def exact_by_levels(starts: DataFrame, edges: DataFrame, alpha: float, levels: int) -> DataFrame:
    """(node, score) of a graph in which every edge goes from a level to the next, from starts (id, level, w).

    No path can meet itself there, so the expected visits of a level follow from the one before
    by one join and one sum."""
    edges = kept(edges)
    degree = edges.groupBy(F.col("src").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    out = kept(edges.join(degree, F.col("src") == F.col("s")).select("src", "dst", (F.lit(alpha) / F.col("n")).alias("p")))
    now = starts.where("level = 0").select(F.col("id").alias("node"), "w")
    every = now
    for level in range(1, levels):
        into = now.join(out, F.col("node") == F.col("src")).groupBy("dst").agg(F.sum(F.col("w") * F.col("p")).alias("more"))
        own = starts.where(F.col("level") == level)
        now = own.join(into, F.col("id") == F.col("dst"), "left").select(F.col("id").alias("node"), (F.col("w") + F.coalesce("more", F.lit(0.0))).alias("w"))
        now = kept(now)
        every = every.unionByName(now)
    total = every.agg(F.sum("w")).first()[0]
    return every.select("node", (F.col("w") / F.lit(total)).alias("score"))


class PersonalizedWalk:
    """A long walk made of stored ones: `current` since the last reset, `all` before it."""

    def __init__(self, start: int, target: int):
        self.start, self.target = start, target
        self.current, self.all = [start], []

    @property
    def at(self) -> int:
        return self.current[-1]

    def reached(self) -> bool:
        return len(self.all) >= self.target

    def reset(self) -> None:
        self.all += self.current
        self.current = [self.start]

    def move(self, node: int) -> None:
        self.current.append(node)

    def append(self, piece: list[int]) -> None:
        """Adds the piece up to the first node that `current` has, and resets."""
        seen = set(self.current)
        self.current += piece[: next((i for i, x in enumerate(piece) if x in seen), len(piece))]
        self.reset()


class WalkCache:
    """Stored walks by each of their nodes but the last; each is handed out once."""

    def __init__(self, walks: list[list[int]]):
        self.walks, self.used = walks, [False] * len(walks)
        self.of: dict[int, deque[int]] = {}
        for k, path in enumerate(walks):
            for node in path[:-1]:
                self.of.setdefault(node, deque()).append(k)

    def next(self, node: int) -> list[int] | None:
        left = self.of.get(node, ())
        while left:
            k = left.popleft()
            if not self.used[k]:
                self.used[k] = True
                return self.walks[k]
        return None


def crop(path: list[int], node: int) -> list[int]:
    """What follows the node."""
    if node not in path:
        raise NodeNotInWalk(node)
    return path[path.index(node) + 1 :]


def stitch(source: int, follows, walks: list[list[int]], length: int, config: WalkConfig, salt: int = 0) -> list[int]:
    """A walk of at least `length` visits that begins again at the source whenever a toss says so."""
    cache, walk, limit, step = WalkCache(walks), PersonalizedWalk(source, length), rng.limit(config.alpha), 0
    pool = 1 << 14
    stop, pick = np.zeros(0, np.int64), np.zeros(0, np.int64)
    while not walk.reached():
        if step % pool == 0:
            stop, pick = rng.fast_draws(config.seed, np.arange(step, step + pool), source, salt)
        toss, choice = stop[step % pool], pick[step % pool]
        step += 1
        if toss > limit:
            walk.reset()
            continue
        if (stored := cache.next(walk.at)) is not None:
            walk.append(crop(stored, walk.at))
            continue
        to = follows(walk.at)
        if not len(to) or (node := int(to[choice % len(to)])) in walk.current:
            walk.reset()
            continue
        walk.move(node)
    return walk.all


def sampled(walks: DataFrame, pairs: DataFrame, limit: int, seed: int) -> DataFrame:
    """(source, walk_id, path): for pairs (source, node), at most limit div (the source's nodes) walks through each node, drawn by hashes.

    One pass of the walks for all sources; a ranked limit cuts each node's walks before they are dealt."""
    each = pairs.groupBy("source").agg((F.floor(F.lit(limit) / F.count(F.lit(1)))).alias("each"))
    draw, _ = rng.draw_columns(seed, F.col("walk_id"), 0, 9)
    through = walks.select("walk_id", F.explode("path").alias("node")).join(pairs.join(each, "source"), "node").withColumn("u", draw)
    through = through.withColumn("lane", F.pmod("walk_id", F.lit(64)))
    for keys in (["source", "node", "lane"], ["source", "node"]):
        place = F.row_number().over(W.partitionBy(*keys).orderBy("u", "walk_id"))
        through = through.withColumn("k", place).where("k <= each")
    return through.select("source", "walk_id").distinct().join(walks, "walk_id").select("source", "walk_id", "path")


def personalized(graph: GraphStore, walks: DataFrame, sources: list[int], top_k: int, config: WalkConfig, by_join: bool | None = None) -> DataFrame:
    """(source, node, score): the whole vector of each source; top_k sets only how long its walk is.

    With up to BROADCAST_EDGES edges a source's walk is stitched of stored walks, at most
    walks_needed() of them. A larger graph isn't sent anywhere: as many walks are made anew by
    joins, whose visits have the same expectation."""
    spark = graph.spark
    for s in sources:
        graph.node_by_id(s)
    if top_k < 1:
        raise InvalidTopK(top_k)
    if walks.isEmpty():
        raise EmptyWalkStore
    if not sources:
        return spark.createDataFrame([], "source long, node long, score double")
    length = required_length(top_k, config.alpha)
    needed = walks_needed(length, config.alpha)
    edges = kept(graph.edges.select("src", "dst").distinct())
    asked = spark.createDataFrame([(s,) for s in sorted(set(sources))], "source long")
    if by_join if by_join is not None else not is_small(edges):
        each = F.explode(F.sequence(F.lit(0), F.lit(needed - 1))).alias("k")
        starts = asked.select("source", each).select((F.col("source") * needed + F.col("k")).alias("walk_id"), F.array("source").alias("path"))
        made = grow_by_join(starts, edges, config, FRESH)
        counts = kept(made.select(F.col("path")[0].alias("source"), F.explode("path").alias("node")).groupBy("source", "node").agg(F.count(F.lit(1)).alias("n")))
        total = counts.groupBy("source").agg(F.sum("n").alias("total"))
        return counts.join(total, "source").select("source", "node", (F.col("n") / F.col("total")).alias("score"))
    shared = spark.sparkContext.broadcast(adjacency(edges))
    own = edges.join(asked, F.col("src") == F.col("source")).select("source", F.col("dst").alias("node"))
    pairs = kept(own.unionByName(asked.select("source", F.col("source").alias("node"))).distinct())
    samples = sampled(walks, pairs, needed, config.seed).unionByName(
        asked.select("source", F.lit(-1).cast("long").alias("walk_id"), F.array().cast("array<bigint>").alias("path")))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        source = key[0].as_py()
        rows = sorted((w, p) for w, p in zip(table.column("walk_id").to_pylist(), table.column("path").to_pylist()) if w >= 0)
        adj = shared.value
        seen = [source] if not len(adj.follows(source)) else stitch(source, adj.follows, [p for _, p in rows], length, config)
        nodes, n = np.unique(np.array(seen, np.int64), return_counts=True)
        return pa.table({"source": np.full(len(nodes), source), "node": nodes, "score": n / n.sum()})

    return samples.groupBy("source").applyInArrow(run, "source long, node long, score double")


#: The distance that was measured with so many walks. Fixed values of the accuracy gate.
MEASURED_WALKS, MEASURED_DISTANCE = 2_000_000, 0.05


def expected_distance(active: int, nodes: int, walks_per_node: int) -> float:
    """The distance to expect of ranks by walks from the active nodes: it falls with the root of their count."""
    return MEASURED_DISTANCE / math.sqrt(active * walks_per_node / MEASURED_WALKS) * (nodes / active)
