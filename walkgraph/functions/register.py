"""The engine's functions under names that SQL can call."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkgraph.config import WalkConfig
from walkgraph.functions import scalars
from walkgraph.operators import rank, walks


def register(spark: SparkSession, edges: DataFrame, config: WalkConfig) -> None:
    """is_valid_pubkey(key), random_walks(node) and personalized_rank(node, length) over these edges.

    The edges go to the workers, so their count is checked: the table functions are for graphs
    of up to walks.BROADCAST_EDGES edges. personalized_rank makes its walk without stored ones."""
    if not walks.is_small(edges):
        raise ValueError(f"more than {walks.BROADCAST_EDGES} edges")
    shared = spark.sparkContext.broadcast(walks.adjacency(edges))

    class RandomWalks:
        def eval(self, node: int):
            ids = node * config.walks_per_node + np.arange(config.walks_per_node)
            for w, path in zip(ids.tolist(), walks.grow(shared.value, ids, np.full(len(ids), node), config, walks.GENERATE)):
                yield w, path.tolist()

    class PersonalizedRank:
        def eval(self, node: int, length: int):
            follows = shared.value.follows
            seen = rank.stitch(node, follows, [], length, config) if len(follows(node)) else [node]
            nodes, n = np.unique(np.array(seen), return_counts=True)
            for x, k in zip(nodes.tolist(), n.tolist()):
                yield x, k / len(seen)

    spark.udf.register("is_valid_pubkey", scalars.is_valid_pubkey)
    spark.udtf.register("random_walks", F.udtf(RandomWalks, returnType="walk_id bigint, path array<bigint>"))
    spark.udtf.register("personalized_rank", F.udtf(PersonalizedRank, returnType="node bigint, score double"))
