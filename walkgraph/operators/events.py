"""Batches of events: the newest of each author and kind, follow lists, and what they change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walkgraph.config import WalkConfig
from walkgraph.functions import scalars
from walkgraph.operators import walks as walk_ops
from walkgraph.operators.graph import GraphStore, append_nodes, parts_of, update_follows
from walkgraph.schemas import ACTIVE, FOLLOW_LIST, PROFILE
from walkgraph.sources.state import kept


def known_authors(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Events of kinds in use by authors that are nodes, active or not."""
    return events.where(F.col("kind").isin(FOLLOW_LIST, PROFILE)).join(nodes.select("pubkey"), "pubkey", "left_semi")


def dispatched(events: DataFrame) -> DataFrame:
    """events with handler: follow_list, profile or unsupported."""
    return events.withColumn("handler", F.when(F.col("kind") == FOLLOW_LIST, "follow_list").when(F.col("kind") == PROFILE, "profile").otherwise("unsupported"))


def latest(events: DataFrame) -> DataFrame:
    """The newest event of each (pubkey, kind); of equally new ones that with the least id.

    An aggregate, so a busy author's events meet in no task."""
    columns = [c for c in events.columns if c not in ("pubkey", "kind", "created_at", "id")]
    best = F.min_by(F.struct("id", "created_at", *columns), F.struct(-F.col("created_at"), F.col("id")))
    return events.groupBy("pubkey", "kind").agg(best.alias("e")).select("pubkey", "kind", "e.*").select(*events.columns)


def replaced(events: DataFrame, stored: DataFrame) -> DataFrame:
    """The newest events of a batch that are newer than those stored, which they replace."""
    old = stored.groupBy("pubkey", "kind").agg(F.max("created_at").alias("__old"))
    return latest(events).join(old, ["pubkey", "kind"], "left").where("__old is null or created_at > __old").drop("__old")


def merged(events: DataFrame, stored: DataFrame) -> DataFrame:
    """What is stored afterwards: ties go to what was there."""
    fresh = replaced(events, stored)
    return stored.join(fresh.select("pubkey", "kind"), ["pubkey", "kind"], "left_anti").unionByName(fresh)


def follow_keys(events: DataFrame) -> DataFrame:
    """events with keys, the sorted public keys that they follow."""
    return events.withColumn("keys", scalars.follow_tags("tags", F.col("pubkey")))


def new_keys(lists: DataFrame, nodes: DataFrame, check: bool = True) -> DataFrame:
    """(pubkey): unknown valid keys in lists (pubkey, keys) of active authors; those of inactive ones don't count."""
    active = lists.join(nodes.where(F.col("status") == ACTIVE).select("pubkey"), "pubkey", "left_semi")
    found = active.select(F.explode("keys").alias("pubkey")).distinct().join(nodes, "pubkey", "left_anti")
    return found.where(scalars.is_valid_pubkey("pubkey")) if check else found


def resolved(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, new): the sorted ids of the keys in lists (pubkey, keys) that are nodes, for authors that are."""
    author = nodes.select("pubkey", F.col("id").alias("node_id"))
    pairs = lists.join(author, "pubkey").select("node_id", F.explode_outer("keys").alias("pubkey"))
    ids = pairs.join(nodes.select("pubkey", "id"), "pubkey", "left")
    return ids.groupBy("node_id").agg(F.array_sort(F.collect_set("id")).alias("new"))


def follow_deltas(lists: DataFrame, edges: DataFrame) -> DataFrame:
    """lists (node_id, new) as (node_id, removed, common, added) against the edges."""
    old = edges.join(lists.select(F.col("node_id").alias("src")), "src", "left_semi").groupBy(F.col("src").alias("node_id")).agg(F.array_sort(F.collect_list("dst")).alias("old"))
    return parts_of(lists.join(old, "node_id", "left").select("node_id", F.coalesce("old", F.array().cast("array<bigint>")).alias("old"), "new"))


def apply_graph(events: DataFrame, graph: GraphStore, now: Column, check: bool = True) -> tuple[GraphStore, DataFrame]:
    """The graph after a batch of newest follow lists, one for each author, and the deltas they made.

    Different authors change different edges, so all are applied at once; a new key in several
    lists becomes one node."""
    lists = follow_keys(known_authors(events, graph.nodes).where(F.col("kind") == FOLLOW_LIST)).select("pubkey", "keys")
    lists = kept(lists)
    nodes = kept(append_nodes(graph.nodes, new_keys(lists, graph.nodes, check), now))
    deltas = kept(follow_deltas(resolved(lists, nodes), graph.edges))
    return GraphStore(nodes, kept(update_follows(graph.edges, deltas))), deltas


def apply_serial(events: DataFrame, graph: GraphStore, walks: DataFrame, config: WalkConfig, now: Column, number: int = 0, check: bool = True) -> tuple[GraphStore, DataFrame, int]:
    """Events' lists applied author by author, in the order of time: graph, walks, and how many walks changed.

    Walk updates see the graph as it is after each list. The loop is over authors in a
    micro-batch, whose count the trigger bounds; each pass is distributed over the walks."""
    fresh = kept(latest(events))
    changed = 0
    for row in fresh.where(F.col("kind") == FOLLOW_LIST).orderBy("created_at", "id").select("id").toLocalIterator():
        graph, deltas = apply_graph(fresh.where(F.col("id") == row["id"]), graph, now, check)
        for d in deltas.collect():
            number += 1
            walks, n = walk_ops.update(walks, graph.edges, d["node_id"], d["removed"], d["common"], d["added"], config, number)
            changed += n
    return graph, walks, changed


def apply_bulk(events: DataFrame, graph: GraphStore, walks: DataFrame, config: WalkConfig, now: Column, number: int = 0, check: bool = True, by_join: bool | None = None) -> tuple[GraphStore, DataFrame, int]:
    """All lists of a batch at once: affected walks are those that pass through a node whose follows changed.

    Such a walk is kept up to the first of these nodes and grown anew from there on the new
    graph, with draws of this update. That is its distribution on the new graph given the kept
    part, without the bias of grafting; it changes more walks than the serial way."""
    after, deltas = apply_graph(latest(events), graph, now, check)
    moved = kept(deltas.where("size(removed) > 0 or size(added) > 0").select("node_id"))
    cut = walks.select("walk_id", F.posexplode("path").alias("pos", "node")).join(moved, F.col("node") == F.col("node_id")).groupBy("walk_id").agg((F.min("pos") + 1).alias("cut"))
    hit = kept(walks.join(cut, "walk_id").select("walk_id", F.slice("path", 1, F.col("cut")).alias("path")))
    left = walks.join(hit.select("walk_id"), "walk_id", "left_anti")
    grown = walk_ops.regrow(hit, after.edges, config, 4 * (number + 1), by_join)
    return after, kept(left.unionByName(grown)), hit.count()
