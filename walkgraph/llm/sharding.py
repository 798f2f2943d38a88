"""Sharding: a keyed Feistel permutation of global row numbers deals all rows evenly into shards.

Rows are numbered from 0 in the order of id, size and text hash, without gaps; the permutation,
with cycle walking, sends number i to place p, so p modulo the count of shards is the row's
shard and p divided by it its slot. The law that holds is `rows`: shards' counts are at most one
apart and slots have no gaps. Given the number and the key, shard and slot are computable
without any table, and the order of the rows in the input doesn't matter. Equal texts are
different rows: under this law a group of copies can't be kept in one shard, as it may be larger
than one.

Numbering deals rows by ranges, so a hot id or text meets in no single task; only counts of
ranges come to the driver.

Defined cases: a null text has size 1 and the checksum of no bytes, 0. Rows with a null id come
first. Rows equal in id and text are dealt out in any order. No rows: no shards. A column of
documents named as a result is replaced.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from walkgraph.llm.common import numbered, permuted

SHARDS = 16
KEY = 0x5EED
RESULT = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def place(df: DataFrame, count: int, key: int, number: str, name: str) -> DataFrame:
    """Adds `name`, the permuted `number`."""

    def run(batches):
        for batch in batches:
            to = permuted(batch.column(number).to_numpy(), count, key)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to)], schema=batch.schema.append(pa.field(name, pa.int64())))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))


def shard(docs: DataFrame, shards: int = SHARDS, key: int = KEY, carry: list[str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """documents with size (bytes and 1), text_crc32, law, shard, slot and grown_shard (null under this law)."""
    kept = [c for c in (docs.columns if carry is None else carry) if c not in RESULT]
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        *kept, F.col(doc_id).alias("__order"), F.xxhash64(whole).alias("__hash"),
        (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole).cast("long").alias("text_crc32"))
    rows, count = numbered(rows, ["__order", "size", "__hash"], "__number")
    out = place(rows.drop("__order", "__hash"), count, key, "__number", "__place")
    return out.select(
        *kept, "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("__place") % shards).cast("int").alias("shard"), F.expr(f"__place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def locate(number: int, count: int, shards: int = SHARDS, key: int = KEY) -> tuple[int, int]:
    """Shard and slot of a row number."""
    import numpy as np

    at = int(permuted(np.array([number]), count, key)[0])
    return at % shards, at // shards
