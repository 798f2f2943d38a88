"""Reads and changes of the nodes and edges tables. Changes return new DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from walkgraph.errors import EmptyGraph, MissingDelta, NodeAlreadyExists, NodeNotFound
from walkgraph.functions import scalars
from walkgraph.sources.state import kept
from walkgraph.schemas import ACTIVE, DEMOTION, EDGES, FOLLOW_LIST, INACTIVE, NODES, PROMOTION


@dataclass(frozen=True)
class Delta:
    """A change of one node."""

    kind: int
    node_id: int
    removed: tuple[int, ...] = ()
    added: tuple[int, ...] = ()

    def inverse(self) -> Delta:
        return replace(self, removed=self.added, added=self.removed)


def unchanged(edges: DataFrame, delta: Delta) -> DataFrame:
    """(dst): the follows of the delta's node that it neither removes nor adds."""
    mine = edges.where(F.col("src") == delta.node_id).select("dst").distinct()
    return mine.where(~F.col("dst").isin([*delta.removed, *delta.added])) if delta.removed or delta.added else mine


def size(nodes: DataFrame) -> DataFrame:
    """(n): the count of nodes."""
    return nodes.agg(F.count(F.lit(1)).alias("n"))


def record_list(nodes: DataFrame) -> DataFrame:
    """nodes with `records`, their history as (kind, ts), ordered by kind."""
    kinds = [(-3, "added_ts"), (PROMOTION, "promotion_ts"), (DEMOTION, "demotion_ts")]
    every = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("ts")) for k, c in kinds])
    return nodes.withColumn("records", F.filter(every, lambda r: r["ts"].isNotNull()))


def record(records: str | Column, kind: int) -> Column:
    """When a record of this kind was made, the last if there are several; null if there is none."""
    return F.array_max(F.transform(F.filter(records, lambda r: r["kind"] == kind), lambda r: r["ts"]))


def parse_node(fields: str | Column) -> Column:
    """A node from a map of strings; unknown fields are ignored, an empty map is null."""
    m = F.col(fields) if isinstance(fields, str) else fields
    ts = [F.timestamp_seconds(F.try_element_at(m, F.lit(c)).cast("long")).alias(c) for c in ("added_ts", "promotion_ts", "demotion_ts")]
    node = F.struct(F.try_element_at(m, F.lit("id")).cast("long").alias("id"), *[F.try_element_at(m, F.lit(c)).alias(c) for c in ("pubkey", "status")], *ts)
    return F.when(F.cardinality(m) > 0, node)


def node_ids(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """keys (pos, pubkey) with id, null where it is unknown."""
    return keys.join(nodes.select("pubkey", "id"), "pubkey", "left").select("pos", "pubkey", "id")


def pubkeys(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """ids (pos, id) with pubkey, null where it is unknown."""
    return ids.join(nodes.select("id", "pubkey"), "id", "left").select("pos", "id", "pubkey")


def contains(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """ids (id) with found."""
    return ids.join(nodes.select("id", F.lit(True).alias("found")), "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))


def adjacency(ids: DataFrame, edges: DataFrame, key: str = "src", other: str = "dst") -> DataFrame:
    """ids (id) with `list`, the sorted other ends of their edges; an empty list where there are none."""
    lists = edges.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_semi").groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(other)).alias("list"))
    return ids.join(lists, "id", "left").select("id", F.coalesce("list", F.array().cast("array<bigint>")).alias("list"))


def degrees(ids: DataFrame, edges: DataFrame, key: str = "src") -> DataFrame:
    """ids (id) with n, the edges from (key src) or to (key dst) them; 0 where an id is unknown."""
    n = edges.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return ids.join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def update_follows(edges: DataFrame, deltas: DataFrame) -> DataFrame:
    """edges after deltas (node_id, removed, added): what is added comes first, so an id in both goes."""
    added = deltas.select(F.col("node_id").alias("src"), F.explode("added").alias("dst"))
    removed = deltas.select(F.col("node_id").alias("src"), F.explode("removed").alias("dst"))
    return edges.unionByName(added).distinct().join(removed, ["src", "dst"], "left_anti")


def append_nodes(nodes: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """nodes and new ones for keys (pubkey) that it doesn't have, with ids after its largest, in the order of the keys.

    New keys are numbered by ranges of keys; only the ranges' counts come to the driver."""
    spark = nodes.sparkSession
    new = keys.select("pubkey").where(F.col("pubkey").isNotNull()).distinct().join(nodes, "pubkey", "left_anti")
    largest = nodes.agg(F.max("id")).first()[0]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(new.repartitionByRange(n, "pubkey").withColumn("__pid", F.spark_partition_id()))
    before, starts = (-1 if largest is None else largest) + 1, []
    for r in dealt.groupBy("__pid").count().orderBy("__pid").collect():
        starts.append((r["__pid"], before))
        before += r["count"]
    numbers = spark.createDataFrame(starts, "__pid int, __from long")
    inside = F.row_number().over(W.partitionBy("__pid").orderBy("pubkey")) - 1
    made = dealt.withColumn("__at", inside).join(F.broadcast(numbers), "__pid").select(
        (F.col("__from") + F.col("__at")).alias("id"), "pubkey", F.lit(INACTIVE).alias("status"), now.alias("added_ts"),
        F.lit(None).cast("timestamp").alias("promotion_ts"), F.lit(None).cast("timestamp").alias("demotion_ts"))
    return nodes.unionByName(made)


def set_status(nodes: DataFrame, ids: DataFrame, status: str, now: Column) -> DataFrame:
    """nodes with those in ids (id) promoted or demoted now."""
    column = "promotion_ts" if status == ACTIVE else "demotion_ts"
    marked = nodes.join(ids.select("id", F.lit(True).alias("__hit")).distinct(), "id", "left")
    hit = F.col("__hit").isNotNull()
    return marked.withColumn("status", F.when(hit, status).otherwise(F.col("status"))).withColumn(column, F.when(hit, now).otherwise(F.col(column))).select(*nodes.columns)


class GraphStore:
    """Nodes and edges, with the calls that check that what they name exists."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges, self.spark = nodes, edges, nodes.sparkSession

    @classmethod
    def create(cls, spark: SparkSession) -> GraphStore:
        return cls(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))

    @classmethod
    def from_pubkeys(cls, spark: SparkSession, keys: list[str], now: Column | None = None) -> GraphStore:
        return cls.create(spark).add_nodes(keys, now)

    def _ids(self, ids) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id long")

    def all_nodes(self) -> DataFrame:
        return self.nodes.select("id").distinct()

    def scan(self, batches: int) -> DataFrame:
        """All nodes in that many partitions, ranges of ids."""
        return self.nodes.repartitionByRange(batches, "id")

    def size(self) -> int:
        return size(self.nodes).first()["n"]

    def contains_node(self, node_id: int) -> bool:
        return not self.nodes.where(F.col("id") == node_id).isEmpty()

    def node_by_id(self, node_id: int):
        return self._one(F.col("id") == node_id, node_id)

    def node_by_key(self, key: str):
        return self._one(F.col("pubkey") == key, key)

    def _one(self, which: Column, name):
        found = self.select(which).take(1)
        if not found:
            raise NodeNotFound(name)
        return found[0]

    def select(self, which: Column) -> DataFrame:
        """The nodes that a condition names."""
        return self.nodes.where(which)

    def _known(self, ids: list[int]) -> DataFrame:
        frame = self._ids(ids)
        if missing := frame.join(self.nodes, "id", "left_anti").take(1):
            raise NodeNotFound(missing[0]["id"])
        return frame

    def follows(self, *ids: int) -> DataFrame:
        return adjacency(self._known(list(ids)), self.edges)

    def followers(self, *ids: int) -> DataFrame:
        return adjacency(self._known(list(ids)), self.edges, "dst", "src")

    def follow_counts(self, *ids: int) -> DataFrame:
        return degrees(self._ids(ids), self.edges)

    def follower_counts(self, *ids: int) -> DataFrame:
        return degrees(self._ids(ids), self.edges, "dst")

    def node_ids(self, *keys: str) -> DataFrame:
        return node_ids(self.spark.createDataFrame(list(enumerate(keys)), "pos int, pubkey string"), self.nodes)

    def pubkeys(self, *ids: int) -> DataFrame:
        return pubkeys(self.spark.createDataFrame(list(enumerate(ids)), "pos int, id long"), self.nodes)

    def add_node(self, key: str, now: Column | None = None) -> GraphStore:
        if not self.nodes.where(F.col("pubkey") == key).isEmpty():
            raise NodeAlreadyExists(key)
        return self.add_nodes([key], now)

    def add_nodes(self, keys: list[str], now: Column | None = None) -> GraphStore:
        frame = self.spark.createDataFrame([(k,) for k in keys], "pubkey string")
        return GraphStore(append_nodes(self.nodes, frame, F.current_timestamp() if now is None else now), self.edges)

    def update(self, delta: Delta | None, now: Column | None = None) -> GraphStore:
        """A delta of unknown kind changes nothing."""
        if delta is None:
            raise MissingDelta
        self.node_by_id(delta.node_id)
        now = F.current_timestamp() if now is None else now
        if delta.kind in (PROMOTION, DEMOTION):
            status = ACTIVE if delta.kind == PROMOTION else INACTIVE
            return GraphStore(set_status(self.nodes, self._ids([delta.node_id]), status, now), self.edges)
        if delta.kind == FOLLOW_LIST:
            row = [(delta.node_id, list(delta.removed), list(delta.added))]
            return GraphStore(self.nodes, update_follows(self.edges, self.spark.createDataFrame(row, "node_id long, removed array<long>, added array<long>")))
        return self

    def require_nodes(self) -> None:
        if self.nodes.isEmpty():
            raise EmptyGraph


def random_graph(spark: SparkSession, n: int, k: int, seed: int = 0) -> GraphStore:
    """n nodes with k follows each, drawn by hashes; a node may follow itself."""
    nodes = spark.range(n).select("id", F.col("id").cast("string").alias("pubkey"), F.lit(ACTIVE).alias("status"), *[F.lit(None).cast("timestamp").alias(c) for c in ("added_ts", "promotion_ts", "demotion_ts")])
    draws = F.transform(F.sequence(F.lit(1), F.lit(4 * k + 8)), lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(n)))
    edges = nodes.select(F.col("id").alias("src"), F.explode(F.slice(F.array_distinct(draws), 1, k)).alias("dst"))
    return GraphStore(nodes, edges)


def parts_of(lists: DataFrame) -> DataFrame:
    """lists (node_id, old, new) as deltas (node_id, removed, common, added)."""
    return lists.select("node_id", scalars.partition("old", "new").alias("s")).select("node_id", "s.*")
