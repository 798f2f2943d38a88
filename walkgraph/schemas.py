"""Tables of the engine. All ids are LONG."""

from pyspark.sql import types as T

ACTIVE, INACTIVE = "active", "inactive"
#: Kinds of events, records and deltas. Fixed values of the event format.
FOLLOW_LIST, PROFILE = 3, 0
ADDED, PROMOTION, DEMOTION = -3, -2, -1

NODES = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("pubkey", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("added_ts", T.TimestampType()), T.StructField("promotion_ts", T.TimestampType()), T.StructField("demotion_ts", T.TimestampType()),
])
EDGES = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])
WALKS = T.StructType([T.StructField("walk_id", T.LongType()), T.StructField("path", T.ArrayType(T.LongType()))])
EVENTS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("pubkey", T.StringType()), T.StructField("kind", T.IntegerType()),
    T.StructField("created_at", T.LongType()), T.StructField("tags", T.ArrayType(T.ArrayType(T.StringType()))),
])
RANKS = T.StructType([T.StructField("node", T.LongType()), T.StructField("score", T.DoubleType())])
