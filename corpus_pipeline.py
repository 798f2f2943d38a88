"""Quality rules, near-duplicate removal, substring removal, decontamination and packing of a corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes and reads
again as the next one's documents. All but the last return the columns of documents.

A stage's result has to be written before the next stage is called: that call removes the tables
that the stage before has left in the shared folder, so they don't add up over the stages."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from walkgraph.llm import common
from walkgraph.llm import decontaminate, encoding, packing, quality, simhash, substrings
from walkgraph.llm.common import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_LEFT: list[str] = []


def stage(make: Stage) -> Stage:
    @wraps(make)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _LEFT:
            common.drop(spark, _LEFT.pop())
        before = common.written_count()
        out = make(spark, docs, sf_dir)
        _LEFT.extend(common.written_since(before))
        return out

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the rules reject."""
    return quality.good(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_of_each(docs)


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of words that an earlier document has."""
    return substrings.shortened(docs)


@stage
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold benchmark passages."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids in length buckets and batches."""
    return packing.pack(docs, ids=encoding.public_ranks())


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("substring dedup", repeated_passages),
    ("decontamination", benchmark_passages),
    ("packing", batches),
]

#: SimHash components and the packing's dynamic program aren't expressible; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, each in STAGES:
        docs = written(each(spark, docs, sf_dir))
    return docs
