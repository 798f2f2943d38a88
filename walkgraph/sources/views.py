"""The graph model over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from walkgraph.schemas import ACTIVE, INACTIVE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def handoff_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from each event's user to the next event's on the same day."""
    after = F.lead("user_id").over(W.partitionBy(F.date_trunc("day", "ts")).orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), after.alias("dst"))
    return rows.where("dst is not null and dst <> src").distinct()


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users, with every third of them active; added at their first event."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.min(F.col("ts").cast("timestamp")).alias("added_ts"))
    return rows.select("id", F.md5(F.col("id").cast("string")).alias("pubkey"), F.when(F.col("id") % 3 == 0, ACTIVE).otherwise(INACTIVE).alias("status"), "added_ts")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the follow-list format: views are follow lists, clicks profiles, others of an unknown kind."""
    return _as_events(table(spark, sf_dir, "events"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events() as a stream, a file at a time."""
    path = f"{sf_dir}/events.parquet"
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 1)
    # A stream reads a folder: the table itself, or the one that its file is in.
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    return _as_events(source.parquet(path) if folder else source.option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def _as_events(rows: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    key = lambda c: F.md5(c.cast("string"))
    kind = F.when(F.col("event_type") == "view", 3).when(F.col("event_type") == "click", 0).otherwise(1)
    user = F.col("user_id")
    tags = F.array(F.array(F.lit("p"), key(k)), F.array(F.lit("p"), key((k * 7) % 100)), F.array(F.lit("e"), key(k)), F.array(F.lit("p"), key(user)), F.array(F.lit("p")))
    return rows.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), key(user).alias("pubkey"), kind.alias("kind"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("created_at"), tags.alias("tags"), "user_id", k.alias("k"))


#: Offsets that keep the ids of the trade graph's levels apart.
SUPPLIERS, NATIONS, REGIONS = 10**9, 2 * 10**9, 3 * 10**9


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to supplier (who sold to them), supplier to nation, nation to region."""
    sold = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    sold = sold.select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + SUPPLIERS).alias("dst")).distinct()
    home = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + SUPPLIERS).alias("src"), (F.col("s_nationkey") + F.lit(NATIONS)).cast("long").alias("dst"))
    part = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + F.lit(NATIONS)).cast("long").alias("src"), (F.col("n_regionkey") + F.lit(REGIONS)).cast("long").alias("dst"))
    return sold.unionByName(home).unionByName(part)


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = [("customer", "c_custkey", 0), ("supplier", "s_suppkey", SUPPLIERS), ("nation", "n_nationkey", NATIONS), ("region", "r_regionkey", REGIONS)]
    frames = [table(spark, sf_dir, t).select((F.col(c).cast("long") + F.lit(o).cast("long")).alias("id"), F.lit(level).alias("level")) for level, (t, c, o) in enumerate(ids)]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])
