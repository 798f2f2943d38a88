"""The table of walks: reads, changes, and the index of visits derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from walkgraph.config import WalkConfig
from walkgraph.errors import EmptyWalk, InvalidWalkIndex, WalkNotFound
from walkgraph.functions import rng, scalars
from walkgraph.schemas import WALKS


def visits(walks: DataFrame) -> DataFrame:
    """(node, walk_id, pos)."""
    return walks.select(F.posexplode("path").alias("pos", "node"), "walk_id").select("node", "walk_id", "pos")


def visit_counts(walks: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(node, visits) of all nodes visited, or of ids (id), 0 where there are none.

    A walk visits a node once, so rows are counted, not distinct walks."""
    n = walks.select(F.explode("path").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("visits"))
    if ids is None:
        return n
    return ids.select(F.col("id").alias("node")).join(n, "node", "left").select("node", F.coalesce("visits", F.lit(0)).alias("visits"))


def total_visits(walks: DataFrame) -> DataFrame:
    return walks.agg(F.coalesce(F.sum(F.size("path").cast("long")), F.lit(0)).alias("total_visits"))


def visiting_all(walks: DataFrame, ids: list[int]) -> DataFrame:
    """The walks that visit every one of ids; none if there are no ids."""
    if not ids:
        return walks.select("walk_id").limit(0)
    every: Column = F.lit(True)
    for x in ids:
        every = every & F.array_contains("path", F.lit(x).cast("long"))
    return walks.where(every).select("walk_id")


def visiting(walks: DataFrame, limit: int, ids: list[int], seed: int = 42) -> DataFrame:
    """(walk_id) of at most limit div len(ids) walks through each of ids, drawn by hashes; -1: all; 0: none."""
    if limit < -1:
        raise ValueError("limit is -1 or more")
    each = -1 if limit == -1 else limit // max(len(ids), 1)
    if not ids or each == 0:
        return walks.select("walk_id").limit(0)
    wanted = F.array(*[F.lit(x).cast("long") for x in sorted(set(ids))])
    found = walks.select("walk_id", F.explode(F.array_intersect("path", wanted)).alias("node"))
    if each > 0:
        draw, _ = rng.draw_columns(seed, F.col("walk_id"), 0, 9)
        ranked = found.withColumn("k", F.row_number().over(W.partitionBy("node").orderBy(draw, "walk_id")))
        found = ranked.where(F.col("k") <= each)
    return found.select("walk_id").distinct()


def inconsistencies(walks: DataFrame, index: DataFrame) -> DataFrame:
    """(node, walk_id) of walks and an index (node, walk_id) that only one of them has; no rows if all is well."""
    mine, theirs = visits(walks).select("node", "walk_id").distinct(), index.select("node", "walk_id").distinct()
    return mine.join(theirs, ["node", "walk_id"], "left_anti").unionByName(theirs.join(mine, ["node", "walk_id"], "left_anti"))


class WalkStore:
    """Walks with their settings. Changes give a new store, or raise and change nothing."""

    def __init__(self, walks: DataFrame, config: WalkConfig, last_id: int | None = None):
        self.walks, self.config, self.spark = walks, config, walks.sparkSession
        self._last = last_id

    @classmethod
    def create(cls, spark: SparkSession, alpha: float = 0.85, walks_per_node: int = 100, seed: int = 42) -> WalkStore:
        return cls(spark.createDataFrame([], WALKS), WalkConfig(alpha, walks_per_node, seed), -1)

    @property
    def alpha(self) -> float:
        return self.config.alpha

    @property
    def walks_per_node(self) -> int:
        return self.config.walks_per_node

    def last_id(self) -> int:
        """The largest walk id given out so far; ids of removed walks aren't used again."""
        if self._last is None:
            found = self.walks.agg(F.max("walk_id")).first()[0]
            self._last = -1 if found is None else found
        return self._last

    def _wanted(self, ids: list[int]) -> DataFrame:
        frame = self.spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "pos int, walk_id long")
        if missing := frame.join(self.walks, "walk_id", "left_anti").take(1):
            raise WalkNotFound(missing[0]["walk_id"])
        return frame

    def get(self, *ids: int) -> DataFrame:
        """(pos, walk_id, path) in the order asked for."""
        return self._wanted(list(ids)).join(self.walks, "walk_id").select("pos", "walk_id", "path").orderBy("pos")

    def add(self, paths: list[list[int]]) -> WalkStore:
        if any(not p for p in paths):
            raise EmptyWalk
        first = self.last_id() + 1
        new = self.spark.createDataFrame([(first + k, list(p)) for k, p in enumerate(paths)], WALKS)
        return WalkStore(self.walks.unionByName(new), self.config, first + len(paths) - 1)

    def add_frame(self, paths: DataFrame) -> WalkStore:
        """As add(), for a DataFrame (path) of any size, in the order of the paths."""
        from walkgraph.sources.state import kept

        if not paths.where(F.coalesce(F.size("path"), F.lit(0)) < 1).isEmpty():
            raise EmptyWalk
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = kept(paths.select("path").repartitionByRange(n, "path").withColumn("__pid", F.spark_partition_id()))
        at, starts = self.last_id() + 1, []
        for r in dealt.groupBy("__pid").count().orderBy("__pid").collect():
            starts.append((r["__pid"], at))
            at += r["count"]
        inside = F.row_number().over(W.partitionBy("__pid").orderBy("path")) - 1
        new = dealt.withColumn("__at", inside).join(F.broadcast(self.spark.createDataFrame(starts, "__pid int, __from long")), "__pid")
        return WalkStore(self.walks.unionByName(new.select((F.col("__from") + F.col("__at")).alias("walk_id"), "path")), self.config, at - 1)

    def remove(self, *ids: int) -> WalkStore:
        gone = self._wanted(list(ids))
        return WalkStore(self.walks.join(gone, "walk_id", "left_anti"), self.config, self.last_id())

    def prune_graft(self, walk_id: int, cut: int, new: list[int]) -> WalkStore:
        """The walk's first `cut` nodes, then the new ones."""
        path = self.get(walk_id).first()["path"]
        if not 0 <= cut <= len(path):
            raise InvalidWalkIndex(cut)
        if cut == 0 and not new:
            raise EmptyWalk(walk_id)
        graft = F.array(*[F.lit(x).cast("long") for x in new]).cast("array<bigint>")
        hit = F.col("walk_id") == walk_id
        return WalkStore(self.walks.withColumn("path", F.when(hit, scalars.prune_graft("path", F.lit(cut), graft)).otherwise(F.col("path"))), self.config, self.last_id())

    def prune(self, walk_id: int, cut: int) -> WalkStore:
        return self.prune_graft(walk_id, cut, [])

    def graft(self, walk_id: int, new: list[int]) -> WalkStore:
        return self.prune_graft(walk_id, len(self.get(walk_id).first()["path"]), new)

    def visit_counts(self, *ids: int) -> DataFrame:
        return visit_counts(self.walks, self.spark.createDataFrame([(i,) for i in ids], "id long"))

    def total_visits(self) -> int:
        return total_visits(self.walks).first()[0]

    def visiting(self, limit: int, *ids: int) -> DataFrame:
        return visiting(self.walks, limit, list(ids), self.config.seed)

    def visiting_all(self, *ids: int) -> DataFrame:
        return visiting_all(self.walks, list(ids))
