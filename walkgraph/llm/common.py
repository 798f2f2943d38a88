"""What the operators share: Arrow kernels over texts, shared-folder tables, row numbers, a permutation."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a kernel works on at once; a longer text is worked on alone.
CHUNK_BYTES = 1 << 21
#: What a row of monotonically_increasing_id() has below the partition's number.
ROW_BITS = 33
U64 = np.uint64
#: A byte that is in no UTF-8 text.
END = 0xFF

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one on a local master, else an error."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir", None):
        return found
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="walkgraph-"))
    return sc._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing has; what is there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_remove)
    _WRITTEN.append((spark, path))
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, kept in the shared folder in their partitions and order."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder; removed when the driver ends."""
    spark = df.sparkSession
    path = fresh_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, level: int) -> DataFrame:
    """written(), with zstd at this level; the shuffles that made df lose their files when the table is whole."""
    spark = df.sparkSession
    path, clean = fresh_path(spark, "table"), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean)
    spark.conf.set(clean, "true")
    try:
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
    finally:
        spark.conf.set(clean, before)
    return spark.read.schema(df.schema).parquet(path)


def written_since(count: int) -> list[str]:
    """What fresh_path() has named but for the first `count` paths."""
    return [path for _, path in _WRITTEN[count:]]


def written_count() -> int:
    return len(_WRITTEN)


def _remove() -> None:
    for spark, path in _WRITTEN:
        drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder that fresh_path() named, if the session still runs."""
    if spark.sparkContext._jsc is None or spark.sparkContext._gateway is None:
        return
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def apart(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with its keys as one column `name` in their place.

    An aggregate by the keys is dealt by them. A join with it on the keys would use that, and
    adaptive execution splits a hot key only where both sides are shuffles made for the join:
    a join on this column deals both sides anew, so that it can."""
    return df.withColumn(name, F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])).drop(*keys)


def key_of(*keys: str) -> Column:
    """What a column made by apart() equals."""
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df less the columns that an operator is about to add."""
    return df.drop(*[c for c in df.columns if c in set(names)])


def sheltered(df: DataFrame, names: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with columns of these names renamed, and what brings its columns back from a frame that has more."""
    hidden = {c: f"__own_{c}" for c in df.columns if c in set(names)}

    def back(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(f"`{hidden.get(c, c)}`").alias(c) for c in df.columns])

    return df.withColumnsRenamed(hidden), back


def with_arrow(
    docs: DataFrame,
    added: list[T.StructField],
    work: Callable[[pa.RecordBatch], list[pa.Array]],
    carry: list[str] | None = None,
    text: str = "text",
) -> DataFrame:
    """Adds columns that work() computes from an Arrow batch of a few MB of text.

    The result has the columns `carry` (all by default) and then those in `added`, which
    replace columns of the same name. Rows aren't moved."""
    names = [f.name for f in added]
    kept = [c for c in (docs.columns if carry is None else carry) if c not in names]
    asked = kept + [c for c in [text] if c not in kept]
    extra = [c for c in docs.columns if c.startswith("__") and c not in asked]
    source = docs.select(*asked, *extra)
    schema = T.StructType([docs.schema[c] for c in kept] + added)
    arrow = [pa.field(f.name, _arrow(f.dataType)) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split(batch, text):
                new = [a.cast(f.type) if a.type != f.type else a for a, f in zip(work(part), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in kept] + new,
                    schema=pa.schema([part.schema.field(c) for c in kept] + arrow),
                )

    return source.mapInArrow(run, schema)


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def split(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about CHUNK_BYTES of text each."""
    if not batch.num_rows:
        return
    _, offsets = flat(batch.column(text))
    cuts, at = [0], 0
    while at < batch.num_rows:
        at = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        at = min(at, batch.num_rows)
        cuts.append(at)
    for lo, hi in zip(cuts, cuts[1:]):
        yield batch.slice(lo, hi - lo)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins; a null is an empty text."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def flat_words(texts: pa.Array, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """flat(), and in it where each word begins and ends, and each text's first word with one end more.

    space tells of each byte whether it is of no word; words don't reach over texts."""
    data, at = flat(texts)
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return data, at, starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, at)


def lines_of_words(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text as ' word word ... word ' and a closing END, all in a row; where the ENDs are.

    table maps bytes: to 0x20 what is not of a word, else to the byte that stands for it."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = pa.large_binary()
    whole = pc.binary_join_element_wise(*[pa.scalar(b" ", kind), texts.cast(kind), pa.scalar(b" \xff", kind), pa.scalar(b"", kind)])
    data, at = flat(whole)
    mapped = table[data]
    mapped[at[1:] - 1] = END
    keep = mapped != 0x20
    keep[1:] |= keep[:-1].copy()
    keep[0] = True
    squeezed = mapped[keep]
    return squeezed, np.flatnonzero(squeezed == END)


def words_in(line: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lines_of_words(): where each word begins and ends, and each text's first word with one end more."""
    space = line == 0x20
    after = np.flatnonzero(space) + 1
    starts = after[line[after] != END]
    stops = np.flatnonzero(space[1:] & ~space[:-1] & (line[:-1] != END)) + 1
    return starts, stops, np.concatenate([[0], np.searchsorted(starts, ends)])


def space_table(lower: bool) -> np.ndarray:
    """For words of other characters than space, tab, line feed, vertical tab, form feed, return."""
    table = np.arange(256, dtype=np.uint8)
    table[9:14] = 0x20
    if lower:
        table[65:91] += 32
    return table


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each bit depends on all."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def permuted(index: np.ndarray, count: int, key: int, rounds: int = 6) -> np.ndarray:
    """Where a keyed Feistel network puts the numbers 0 to count - 1.

    The network permutes all numbers of an even count of bits; a number that it puts
    beyond count walks on along its cycle until it comes back below, so that the result
    is a permutation of 0 to count - 1."""
    half = max(1, (max(count - 1, 1).bit_length() + 1) // 2)
    low = U64((1 << half) - 1)
    keys = mixed(np.arange(1, rounds + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(key & 0xFFFFFFFFFFFFFFFF))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> U64(half), x & low
        for k in keys:
            left, right = right, left ^ (mixed(right + k) & low)
        return (left << U64(half)) | right

    out = once(index.astype(U64))
    while (far := np.flatnonzero(out >= U64(count))).size:
        out[far] = once(out[far])
    return out.astype(np.int64)


def by_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows in the order of `order`, in partitions that are ranges.

    Rows that are equal in `order` are parted by their places, so that a range may begin among them."""
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    keys = [*order, "__tie"]
    return tied.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys).drop("__tie")


def numbered(df: DataFrame, order: list[str], name: str, group: str | None = None) -> tuple[DataFrame, int]:
    """Adds `name`: the rows before this one in the order of `order`, from 0 and without gaps; and the count of all.

    With group, numbers begin at 0 in each value of it, which leads the order. Rows that are
    equal in `order` share their numbers out in any way. The rows are dealt by ranges, kept in the
    shared folder, and counted by range; only these counts, one for each range and each group in
    it, come to the driver. No group meets in one task."""
    spark = df.sparkSession
    keys = ([group] if group else []) + order
    rows = checkpointed(by_ranges(df, keys)).withColumn("__id", F.monotonically_increasing_id())
    rows = rows.withColumn("__pid", F.shiftright("__id", ROW_BITS).cast("int"))
    of = F.col(group).cast("string") if group else F.lit("").cast("string")
    counts = sorted(
        rows.groupBy("__pid", of.alias("g")).agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("first")).collect(),
        key=lambda r: r["first"],
    )
    before: dict[str | None, int] = {}
    lines = []
    for r in counts:
        lines.append((r["__pid"], r["g"], before.get(r["g"], 0), r["first"]))
        before[r["g"]] = before.get(r["g"], 0) + r["n"]
    starts = spark.createDataFrame(lines, "__p int, __g string, __before long, __first long")
    joined = rows.withColumn("__grp", of).join(
        F.broadcast(starts), (F.col("__pid") == F.col("__p")) & F.col("__grp").eqNullSafe(F.col("__g"))
    )
    number = F.col("__before") + F.col("__id") - F.col("__first")
    out = joined.withColumn(name, number).drop("__id", "__pid", "__grp", "__p", "__g", "__before", "__first")
    return out, sum(before.values())
