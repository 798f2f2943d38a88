"""Set operations on rows, and batches of a given size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from walkgraph.sources.state import kept


def partition_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys with part: removed (only in old), common, added (only in new). One shuffle: a count of each side, not a join."""
    sides = old.select(*keys, F.lit(1).alias("s")).unionByName(new.select(*keys, F.lit(2).alias("s")))
    both = sides.groupBy(*keys).agg(F.bit_or("s").alias("s"))
    return both.select(*keys, F.when(F.col("s") == 1, "removed").when(F.col("s") == 2, "added").otherwise("common").alias("part"))


def sorted_walks(walks: DataFrame) -> DataFrame:
    """In the order of the paths, node by node, a shorter one first."""
    return walks.orderBy("path", "walk_id")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with `name`, the rows before this one in the order of `order`.

    Rows are dealt by ranges and counted by range, so no task has them all."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(df.repartitionByRange(n, *order).withColumn("__pid", F.spark_partition_id()))
    before, starts = 0, []
    for r in dealt.groupBy("__pid").count().orderBy("__pid").collect():
        starts.append((r["__pid"], before))
        before += r["count"]
    at = F.row_number().over(W.partitionBy("__pid").orderBy(*order)) - 1
    out = dealt.withColumn("__at", at).join(F.broadcast(spark.createDataFrame(starts, "__pid int, __from long")), "__pid")
    return out.withColumn(name, F.col("__from") + F.col("__at")).select(*df.columns, name)


def batches(df: DataFrame, order: list[str], size: int, name: str) -> DataFrame:
    """df with `name`, the number of its batch of `size` rows in the order of `order`."""
    return numbered(df, order, name).withColumn(name, F.expr(f"`{name}` div {size}"))


def difference_bags(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a less those of b, each as many times as a has it more often."""
    return a.exceptAll(b.select(*a.columns))
