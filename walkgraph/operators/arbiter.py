"""Promotion and demotion of nodes by their visits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walkgraph.config import EngineConfig, WalkConfig
from walkgraph.operators import walkstore
from walkgraph.operators.graph import GraphStore, set_status
from walkgraph.operators.setops import numbered
from walkgraph.operators.walks import generate
from walkgraph.schemas import ACTIVE, INACTIVE
from walkgraph.sources.state import kept


def threshold(multiplier: float, walks_per_node: int) -> int:
    return int(multiplier * walks_per_node + 0.5)


def change_ratio(walks_changed: int, total_visits: int, alpha: float) -> float:
    """Changed walks over the expected count of walks; not a number without visits, which triggers nothing."""
    walks = total_visits * (1 - alpha)
    return walks_changed / walks if walks else (math.nan if not walks_changed else math.inf)


def is_due(walks_changed: int, total_visits: int, alpha: float, config: EngineConfig) -> bool:
    return change_ratio(walks_changed, total_visits, alpha) >= config.node_arbiter_activation_threshold


def decisions(nodes: DataFrame, counts: DataFrame, now: Column, config: EngineConfig, walks_per_node: int) -> DataFrame:
    """nodes with visits and decision: demote, promote or null. counts is (node, visits), one snapshot for all nodes."""
    visits = F.coalesce("visits", F.lit(0))
    demote = (F.col("status") == ACTIVE) & (visits < threshold(config.demotion_multiplier, walks_per_node))
    aged = F.unix_seconds(now) - F.unix_seconds("added_ts") >= config.promotion_wait_period
    promote = (F.col("status") == INACTIVE) & F.col("added_ts").isNotNull() & aged & (visits >= threshold(config.promotion_multiplier, walks_per_node))
    out = nodes.join(counts.withColumnRenamed("node", "id"), "id", "left")
    return out.withColumn("visits", visits).withColumn("decision", F.when(demote, "demote").when(promote, "promote"))


def scan(graph: GraphStore, walks: DataFrame, now: Column, config: EngineConfig, walk_config: WalkConfig, compat: bool = False) -> tuple[GraphStore, DataFrame, DataFrame]:
    """The graph and walks after all decisions, and the promoted nodes' keys (pubkey), to be fetched.

    Decisions are made once and kept; all three results follow from them. Promoted nodes get
    walks, with ids after all others; with compat also if they have some already, which doubles
    them."""
    found = kept(decisions(graph.nodes, walkstore.visit_counts(walks), now, config, walk_config.walks_per_node).where("decision is not null").select("id", "pubkey", "decision"))
    up, down = found.where("decision = 'promote'"), found.where("decision = 'demote'")
    nodes = set_status(set_status(graph.nodes, up, ACTIVE, now), down, INACTIVE, now)
    started = walks.select(F.col("path")[0].alias("id")).distinct()
    starts = up.select("id") if compat else up.select("id").join(started, "id", "left_anti")
    last = walks.agg(F.coalesce(F.max("walk_id"), F.lit(-1))).first()[0]
    starts = numbered(starts, ["id"], "n").select("id", (F.col("n") * walk_config.walks_per_node + last + 1).alias("first"))
    left = walks.withColumn("id", F.col("path")[0]).join(down.select("id"), "id", "left_anti").select("walk_id", "path")
    return GraphStore(nodes, graph.edges), left.unionByName(generate(starts, graph.edges, walk_config)), up.select("pubkey")
