"""Structured Streaming: events from JSON lines into the state, promotions out of it and their events back in, and a batcher of keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from walkgraph.config import EngineConfig, logger
from walkgraph.operators import arbiter, events, setops, walkstore
from walkgraph.operators import walks as walk_ops
from walkgraph.operators.graph import GraphStore
from walkgraph.schemas import EDGES, EVENTS, FOLLOW_LIST, NODES, PROFILE, WALKS
from walkgraph.sources.state import StateStore, kept, shared_dir

LOG = logger()


def read_events(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A stream of events from JSON lines; the source's limit holds it back, nothing is dropped."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max_files).json(path)


def newest_lists(stream: DataFrame) -> DataFrame:
    """The newest follow list of each author in a stream of events, once all that is there has been read.

    Each micro-batch is merged into a versioned table in the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/lists-{uuid.uuid4().hex}"
    state = StateStore(spark, f"{path}/state")
    state.commit({"events": spark.createDataFrame([], EVENTS)}, {"batch": "-1"})

    def step(batch: DataFrame, batch_id: int) -> None:
        if batch_id > int(state.properties()["batch"]):
            stored = state.read("events").select(*EVENTS.names)
            state.commit({"events": events.merged(batch.where(F.col("kind") == FOLLOW_LIST), stored)}, {"batch": str(batch_id)})

    out = stream.select(*EVENTS.names).writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/stream")
    out.trigger(availableNow=True).start().awaitTermination()
    return state.read("events").select(*EVENTS.names)


#: Times that a batch of keys is asked for before its keys wait for the next call.
ATTEMPTS = 3
Fetch = Callable[[list[str]], DataFrame]


class Engine:
    """State of a graph, its walks and newest events, advanced batch by batch.

    Whole batches are applied at once; serial=True replays their lists author by author. Each
    step commits one version of all tables, so a step that dies, or comes again, changes nothing
    twice. `promotions` holds the keys that were promoted and whose events are yet to be fetched."""

    def __init__(self, spark: SparkSession, config: EngineConfig, check: bool = True, serial: bool = False):
        self.spark, self.config, self.check, self.serial = spark, config, check, serial
        self.state = StateStore(spark, config.state_path)

    def start(self, keys: list[str] | None = None) -> None:
        """An empty state gets the seed keys as nodes, and their walks."""
        if self.state.version() is not None:
            return
        graph = GraphStore.from_pubkeys(self.spark, list(keys or self.config.init_pubkeys))
        walks = walk_ops.generate_all(graph, self.config.walks)
        none = {"events": self.spark.createDataFrame([], EVENTS), "promotions": self.spark.createDataFrame([], "pubkey string")}
        self._commit(graph, walks, none, {"batch": "-1", "changed": "0", "number": "0", "events": "0", "walks_changed": "0"})

    def graph(self) -> GraphStore:
        return GraphStore(self.state.read("nodes").select(*NODES.names), self.state.read("edges").select(*EDGES.names))

    def walks(self) -> DataFrame:
        return self.state.read("walks").select(*WALKS.names)

    def promotions(self) -> DataFrame:
        return self.state.read("promotions").select("pubkey")

    def _commit(self, graph: GraphStore, walks: DataFrame, tables: dict[str, DataFrame], properties: dict[str, str]) -> None:
        self.state.commit({"nodes": graph.nodes, "edges": graph.edges, "walks": walks, **tables}, properties)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """A micro-batch; one that was processed before changes nothing."""
        if batch_id > int(self.state.properties()["batch"]):
            self._apply(batch, self.promotions(), {"batch": str(batch_id)})

    def _apply(self, batch: DataFrame, promotions: DataFrame, properties: dict[str, str]) -> None:
        held = self.state.properties()
        stored, graph, walks = self.state.read("events").select(*EVENTS.names), self.graph(), self.walks()
        fresh = kept(events.replaced(events.known_authors(batch, graph.nodes), stored))
        apply = events.apply_serial if self.serial else events.apply_bulk
        after, walks, changed = apply(fresh, graph, walks, self.config.walks, F.current_timestamp(), int(held["number"]), self.check)
        n = fresh.count()
        counts = {"changed": int(held["changed"]) + changed, "number": int(held["number"]) + (n if self.serial else 1),
                  "events": int(held["events"]) + n, "walks_changed": int(held["walks_changed"]) + changed}
        self._commit(after, walks, {"events": events.merged(fresh, stored), "promotions": promotions}, properties | {k: str(v) for k, v in counts.items()})
        LOG.info("%s events, %s walks changed", n, changed)

    def arbitrate(self, force: bool = False) -> bool:
        """Promotes and demotes if enough walks have changed, at one moment for all; promoted keys join `promotions`."""
        held = self.state.properties()
        walks, settings = self.walks(), self.config.walks
        total = walkstore.total_visits(walks).first()[0]
        if not force and not arbiter.is_due(int(held["changed"]), total, settings.alpha, self.config):
            return False
        [(now,)] = self.spark.sql("SELECT CAST(current_timestamp() AS STRING)").collect()
        graph, walks, keys = arbiter.scan(self.graph(), walks, F.lit(now).cast("timestamp"), self.config, settings)
        waiting = self.promotions().unionByName(keys).distinct()
        self._commit(graph, walks, {"events": self.state.read("events"), "promotions": waiting}, {"changed": "0"})
        return True

    def fetch_promoted(self, fetch: Fetch) -> int:
        """Asks for the events of promoted keys, query_batch_size keys at a time, and applies them; how many keys are done.

        A batch that fails is asked for again, ATTEMPTS times in all; its keys then stay in
        `promotions`. The keys of a batch, and no others, come to the driver."""
        lists = setops.batches(self.promotions(), ["pubkey"], self.config.query_batch_size, "batch")
        done = 0
        for row in kept(lists.groupBy("batch").agg(F.sort_array(F.collect_list("pubkey")).alias("keys"))).toLocalIterator():
            keys = list(row["keys"])
            if (found := _attempt(fetch, keys)) is None:
                continue
            left = self.promotions().join(self.spark.createDataFrame([(k,) for k in keys], "pubkey string"), "pubkey", "left_anti")
            self._apply(found.select(*EVENTS.names), kept(left), {})
            done += len(keys)
        return done

    def stats(self) -> dict[str, int]:
        """Sizes and counters, for display."""
        held = self.state.properties()
        out = {k: int(held[k]) for k in ("batch", "events", "walks_changed", "changed")}
        return out | {"nodes": self.graph().size(), "walks": self.walks().count(), "waiting": self.promotions().count()}

    def run(self, checkpoint: str, once: bool = False, fetch: Fetch | None = None, **trigger) -> StreamingQuery:
        """The stream of the configured folder; after each batch an arbitration and, with `fetch`, the promoted keys' events."""

        def step(batch: DataFrame, batch_id: int) -> None:
            self.process(batch, batch_id)
            self.arbitrate()
            if fetch is not None:
                self.fetch_promoted(fetch)
            if self.config.display_stats:
                LOG.info("%s", self.stats())

        out = read_events(self.spark, self.config.events_path, self.config.max_files_per_trigger).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        return out.trigger(**({"availableNow": True} if once else trigger or {"processingTime": "10 seconds"})).start()


def _attempt(fetch: Fetch, keys: list[str]) -> DataFrame | None:
    for k in range(ATTEMPTS):
        try:
            return kept(fetch(keys))
        except Exception as error:  # a source may fail in any way; its keys aren't lost
            LOG.warning("%s keys not fetched, attempt %s: %s", len(keys), k + 1, error)
    return None


class KeyBatcher(StatefulProcessor):
    """Collects keys and hands them out when there are `size` of them, or `interval` seconds after the first."""

    def __init__(self, size: int = 50, interval: int = 60):
        self.size, self.interval = size, interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.keys = handle.getListState("keys", "pubkey string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [k for (k,) in self.keys.get()]
        idle = not held
        for frame in rows:
            held += frame["pubkey"].tolist()
        while len(held) >= self.size:
            yield pd.DataFrame({"keys": [held[: self.size]]})
            held, idle = held[self.size :], True
        if held:
            self.keys.put([(k,) for k in held])
            if idle:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.interval)
        else:
            self.keys.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [k for (k,) in self.keys.get()]
        self.keys.clear()
        if held:
            yield pd.DataFrame({"keys": [held]})

    def close(self) -> None:
        pass


def batched_keys(stream: DataFrame, size: int = 50, interval: int = 60, lanes: int = 8) -> DataFrame:
    """A stream (pubkey) as (keys): lists for one query of the event source each. Keys are dealt over lanes."""
    dealt = stream.withColumn("lane", F.pmod(F.xxhash64("pubkey"), F.lit(lanes)))
    return dealt.groupBy("lane").transformWithStateInPandas(KeyBatcher(size, interval), "keys array<string>", "Update", "ProcessingTime")


def fetch_batch(keys: list[str], source: DataFrame) -> DataFrame:
    """The newest events of these authors, of each kind in use, from a table of events."""
    wanted = source.sparkSession.createDataFrame([(k,) for k in keys], "pubkey string")
    return events.latest(source.where(F.col("kind").isin(FOLLOW_LIST, PROFILE)).join(F.broadcast(wanted), "pubkey", "left_semi"))
