"""Acyclic random walks: generation, and incremental update when follows change.

A walk begins at a node. At each step it goes on with probability alpha to a follow drawn
uniformly; it stops if there is none, or if the draw is a node that it has visited (no second
draw). Draws depend on (seed, walk, step, salt) alone, so any plan gives the same walks.

Two plans, for new walks and for those that go on after a cut: with up to BROADCAST_EDGES edges
(counted first) these go to all workers as two arrays, and each partition grows its walks by
itself, with no shuffle. A larger graph is walked by joins, a step for all walks at a time, with
the frontier kept in the shared checkpoint folder. Only walks that change are ever in them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from walkgraph.config import WalkConfig
from walkgraph.errors import EmptyGraph, NodeNotFound
from walkgraph.functions import rng, scalars
from walkgraph.operators.graph import GraphStore
from walkgraph.sources.state import kept

BROADCAST_EDGES = 10_000_000
BATCH = 1 << 16
#: Salts of the draws: of new walks, and of walks grown again (to which an update's number is added).
GENERATE, REMOVED, NEW, SAMPLE = 0, 1, 2, 3


class Adjacency:
    """Sorted follows in two arrays."""

    def __init__(self, src: np.ndarray, dst: np.ndarray):
        order = np.lexsort((dst, src))
        src, self.targets = src[order], dst[order]
        self.ids, first = np.unique(src, return_index=True)
        self.first = np.append(first, len(src))

    def spans(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the nodes' follows begin, and how many there are."""
        if not len(self.ids):
            return np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        at = np.minimum(np.searchsorted(self.ids, nodes), len(self.ids) - 1)
        n = np.where(self.ids[at] == nodes, self.first[at + 1] - self.first[at], 0)
        return self.first[at], n

    def follows(self, node: int) -> np.ndarray:
        first, n = self.spans(np.array([node]))
        return self.targets[first[0] : first[0] + n[0]]


def adjacency(edges: DataFrame) -> Adjacency:
    found = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).distinct().toArrow()
    return Adjacency(found.column(0).to_numpy(), found.column(1).to_numpy())


def grow(adj: Adjacency, walk_ids: np.ndarray, starts: np.ndarray, config: WalkConfig, salt: int, fast: bool = False) -> list[np.ndarray]:
    """A walk from each start."""
    draw, limit = (rng.fast_draws if fast else rng.draws), rng.limit(config.alpha)
    steps, alive = [starts], np.arange(len(starts))
    places = [alive]
    history = starts[:, None]
    while alive.size:
        stop, pick = draw(config.seed, walk_ids[alive], len(steps), salt)
        on = stop <= limit
        alive, history, pick = alive[on], history[on], pick[on]
        first, n = adj.spans(history[:, -1])
        on = n > 0
        alive, history, first, pick = alive[on], history[on], first[on], pick[on] % n[on]
        to = adj.targets[first + pick]
        on = ~(history == to[:, None]).any(axis=1)
        alive, to = alive[on], to[on]
        history = np.column_stack([history[on], to])
        if alive.size:
            steps.append(to)
            places.append(alive)
    of = np.concatenate(places)
    nodes = np.concatenate(steps)[np.argsort(of, kind="stable")]
    return np.split(nodes, np.cumsum(np.bincount(of, minlength=len(starts)))[:-1]) if len(starts) else []


def _lists(paths: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *paths])))


def is_small(edges: DataFrame) -> bool:
    """Whether the edges may go to the driver and to all workers."""
    return edges.count() <= BROADCAST_EDGES


def generate(starts: DataFrame, edges: DataFrame, config: WalkConfig, fast: bool = False, by_join: bool | None = None) -> DataFrame:
    """(walk_id, path): walks_per_node walks from each of starts (id).

    Their ids are id * walks_per_node + 0, 1, ..., or first + 0, 1, ... if starts has that column."""
    r = config.walks_per_node
    starts = starts.select("id", F.col("first") if "first" in starts.columns else (F.col("id") * r).alias("first"))
    edges = kept(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).distinct())
    if by_join if by_join is not None else not is_small(edges):
        each = F.explode(F.sequence(F.lit(0), F.lit(r - 1))).alias("k")
        return grow_by_join(starts.select("id", "first", each).select((F.col("first") + F.col("k")).alias("walk_id"), F.array("id").alias("path")), edges, config, GENERATE)
    shared = edges.sparkSession.sparkContext.broadcast(adjacency(edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, firsts = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            step = max(1, BATCH // r)
            for lo in range(0, len(ids), step):
                walk_ids = (firsts[lo : lo + step, None] + np.arange(r)).ravel()
                paths = grow(shared.value, walk_ids, np.repeat(ids[lo : lo + step], r), config, GENERATE, fast)
                yield pa.RecordBatch.from_arrays([pa.array(walk_ids), _lists(paths)], ["walk_id", "path"])

    return starts.mapInArrow(run, "walk_id long, path array<long>")


def grow_by_join(frontier: DataFrame, edges: DataFrame, config: WalkConfig, salt: int) -> DataFrame:
    """Walks (walk_id, path) grown on from their last nodes, a join with the edges for each step."""
    numbered = kept(edges.select("src", "dst").distinct().select("src", "dst", (F.row_number().over(W.partitionBy("src").orderBy("dst")) - 1).alias("i")))
    degree = kept(numbered.groupBy(F.col("src").alias("s")).agg(F.count(F.lit(1)).alias("n")))
    done, step = [], 1
    while True:
        frontier = kept(frontier)
        if frontier.isEmpty():
            break
        stop, pick = rng.draw_columns(config.seed, F.col("walk_id"), step, salt)
        on = stop <= rng.limit(config.alpha)
        last = F.element_at("path", -1)
        moved = frontier.select("walk_id", "path", on.alias("on"), pick.alias("u"), last.alias("last"))
        moved = moved.join(degree, F.col("on") & (F.col("last") == F.col("s")), "left").withColumn("i", F.col("u") % F.col("n"))
        moved = moved.join(numbered.select(F.col("src").alias("s2"), F.col("i").alias("i2"), "dst"), (F.col("s") == F.col("s2")) & (F.col("i") == F.col("i2")), "left")
        goes = F.col("dst").isNotNull() & ~F.array_contains("path", F.col("dst"))
        moved = kept(moved.select("walk_id", "path", "dst", F.coalesce(goes, F.lit(False)).alias("goes")))
        done.append(moved.where("not goes").select("walk_id", "path"))
        frontier = moved.where("goes").select("walk_id", F.concat("path", F.array("dst")).alias("path"))
        step += 1
    out = frontier.select("walk_id", "path")
    for d in done:
        out = out.unionByName(d)
    return out


def generate_all(graph: GraphStore, config: WalkConfig, fast: bool = False) -> DataFrame:
    graph.require_nodes()
    return generate(graph.nodes.select("id"), graph.edges, config, fast)


def generate_for(graph: GraphStore, node: int, config: WalkConfig, fast: bool = False) -> DataFrame:
    if not graph.contains_node(node):
        raise NodeNotFound(node)
    return generate(graph.nodes.where(F.col("id") == node).select("id"), graph.edges, config, fast)


def remove_starting(walks: DataFrame, node: int) -> DataFrame:
    """The walks that don't begin at the node; those that only visit it stay."""
    return walks.where(F.col("path")[0] != node)


def ids_of(ids: list[int]) -> Column:
    """A list of ids as a constant; one literal, however many there are."""
    if not ids:
        return F.array().cast("array<bigint>")
    return F.split(F.lit(",".join(map(str, ids))), ",").cast("array<bigint>")


def regrow(walks: DataFrame, edges: DataFrame, config: WalkConfig, salt: int, by_join: bool | None = None) -> DataFrame:
    """Walks (walk_id, path) grown on from their last nodes, a toss before each step, up to the first node that they have."""
    edges = kept(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).distinct())
    if by_join if by_join is not None else not is_small(edges):
        return grow_by_join(walks.select("walk_id", "path"), edges, config, salt)
    shared = edges.sparkSession.sparkContext.broadcast(adjacency(edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, heads = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            tails = grow(shared.value, ids, np.array([h[-1] for h in heads], np.int64), config, salt)
            out = []
            for head, tail in zip(heads, tails):
                seen, more = set(head), tail.tolist()[1:]
                out.append(head + more[: next((i for i, x in enumerate(more) if x in seen), len(more))])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(out, pa.list_(pa.int64()))], ["walk_id", "path"])

    return walks.select("walk_id", "path").mapInArrow(run, "walk_id long, path array<long>")


def grafted(walks: DataFrame, edges: DataFrame, candidates: list[int], config: WalkConfig, salt: int, toss: bool, by_join: bool | None = None) -> DataFrame:
    """walks (walk_id, path, cut) cut there; they go on to a candidate drawn uniformly, after a toss if so asked, and from it on.

    A walk without candidates, that fails the toss, or whose candidate it has, ends at the cut."""
    stop, pick = rng.draw_columns(config.seed, F.col("walk_id"), 0, salt)
    goes = (stop <= rng.limit(config.alpha)) if toss else F.lit(True)
    head = F.slice("path", 1, F.col("cut").cast("int"))
    to = F.get(ids_of(candidates), (pick % max(len(candidates), 1)).cast("int"))
    cut = walks.select("walk_id", head.alias("path"), F.when(goes, to).alias("to"))
    on = F.coalesce(~F.array_contains("path", F.col("to")), F.lit(False))
    cut = kept(cut.select("walk_id", F.when(on, F.concat("path", F.array("to"))).otherwise(F.col("path")).alias("path"), on.alias("on")))
    grown = regrow(cut.where("on"), edges, config, salt, by_join)
    return cut.where("not on").select("walk_id", "path").unionByName(grown)


def update(walks: DataFrame, edges: DataFrame, node: int, removed: list[int], common: list[int], added: list[int], config: WalkConfig, number: int = 1, by_join: bool | None = None) -> tuple[DataFrame, int]:
    """walks after the node's follows changed (edges are those after the change), and how many were changed.

    Removed phase: walks with a step from the node to one of the removed are cut after the node
    and go on to one of the common follows; that they go on has been tossed before. Added phase,
    on the result: of the walks through the node a share of added / (common + added), drawn by
    hashes, are cut after the node and, with probability alpha, go on to one of the added. A walk
    may count in both. number tells updates apart: equal numbers draw alike. Only the walks that
    change move."""
    changed = 0
    if removed:
        marked = walks.withColumn("cut", scalars.invalid_step("path", F.lit(node).cast("long"), ids_of(removed)))
        hit = kept(marked.where("cut is not null"))
        changed += hit.count()
        rest = marked.where("cut is null").drop("cut")
        walks = kept(rest.unionByName(grafted(hit, edges, common, config, 4 * number + REMOVED, False, by_join)))
    if added:
        at = F.array_position("path", F.lit(node).cast("long")).cast("int")
        through = walks.withColumn("cut", at).where("cut > 0")
        visits = through.count()
        n = sample_size(len(added), len(common) + len(added), visits)
        order, _ = rng.draw_columns(config.seed, F.col("walk_id"), 0, 4 * number + SAMPLE)
        # Draws have 32 bits: the n-th least bounds the sample, and walk ids decide among equals.
        chosen = kept(through.withColumn("u", order).orderBy("u", "walk_id").limit(n)) if n else through.limit(0)
        changed += n
        rest = walks.join(chosen.select("walk_id"), "walk_id", "left_anti")
        walks = kept(rest.unionByName(grafted(chosen, edges, added, config, 4 * number + NEW, True, by_join)))
    return walks, changed


def sample_size(added: int, current: int, visits: int) -> int:
    """visits * added / current in single precision, rounded half up."""
    if current == 0:
        return 0
    return int(np.float32(added) / np.float32(current) * np.float32(visits) + np.float32(0.5))
