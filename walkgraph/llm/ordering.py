"""Token ids in training order, as binary shards of fixed stride.

The ids of all documents, in the order of id and text hash, each with an end id behind it, are one
stream, which is cut into sequences of LENGTH ids; only the last sequence is padded. A keyed
Feistel permutation with cycle walking sends each sequence's number to its global slot. Slots lie
in shards of PER_SHARD sequences: slot s is sequence s modulo PER_SHARD of shard s divided by
PER_SHARD, at that many strides of the shard's file. What a document has of each sequence is dealt
to tasks by ranges of slots that are cut at bounds of shards, so a shard is one file that one task
writes from its beginning to its end. A reader that has seen n sequences goes on at slot n by
arithmetic and one seek.

Documents are dealt by ranges, encoded once and kept in the shared folder, each with the count of
ids before it in its range; its place in the stream is that and the counts of the ranges before, one
number each. When the table is whole the texts' shuffle is no longer needed and its files go. Rows that are equal in id and text are parted by their places, so neither
a hot id nor many equal rows meet in a task; a long document's sequences spread over all shards.
Ids are compressed wherever they are kept or moved, but for the shards.

A task writes a file under a name of its own and renames it when it is whole, so a task that runs
again, or twice, leaves the same file. A folder without manifest.json isn't whole.

Defined cases: a null or empty text is an end id alone. Rows that are equal in id and text are
each in the stream. Null ids come first. No documents: no shards, a manifest with a total of 0.
Other columns are left out.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from walkgraph.llm.common import by_ranges, partitions, permuted, settled, split
from walkgraph.llm.encoding import KIND, Ranks, squeezed, unsqueezed

LENGTH = 2048
PER_SHARD = 1 << 14
KEY = 0x0DDE5
#: Pieces in an Arrow batch.
BATCH = 1 << 10
#: The zstd level of the kept ids.
LEVEL = 9


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system that a path or URI names, and the path in it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def encoded(docs: DataFrame, ids: Ranks, doc_id: str, text: str) -> DataFrame:
    """(doc, range, before, n, ids): each document's ids, how many with the end id, and how many its range has before it; kept."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc"), whole.alias("text"), F.xxhash64(whole).alias("hash"))
    dealt = by_ranges(rows, ["doc", "hash"]).select("doc", F.spark_partition_id().alias("range"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for whole_batch in batches:
            for batch in split(whole_batch, "text"):
                found = ids.encode(batch.column("text"))
                n = np.array([len(x) // KIND.itemsize + 1 for x in found], np.int64)
                columns = [batch.column("doc"), batch.column("range"), pa.array(before + np.cumsum(n) - n), pa.array(n), pa.array(found, pa.binary())]
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays(columns, ["doc", "range", "before", "n", "ids"])

    kind = dealt.schema["doc"].dataType.simpleString()
    return settled(dealt.mapInArrow(run, f"doc {kind}, range int, before long, n long, ids binary"), LEVEL)


def pieces(docs: DataFrame, ids: Ranks, length: int, key: int, doc_id: str, text: str) -> tuple[DataFrame, int]:
    """(slot, at, doc_id, part, n_tokens, ids): what a document has of a sequence, from its place `at`; and the count of sequences."""
    rows = encoded(docs, ids, doc_id, text)
    starts, tokens = {}, 0
    for r in rows.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect():  # a row for each partition
        starts[r["range"]] = tokens
        tokens += r["n"]
    total, end = -(-tokens // length), np.array([ids.end], KIND).tobytes()
    size = KIND.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch in split(whole_batch, "ids"):
                n = batch.column("n").to_numpy()
                first = batch.column("before").to_numpy() + np.array([starts[r] for r in batch.column("range").to_pylist()])  # places in the stream
                # A document's pieces: one for each sequence that it has ids of.
                many = (first + n - 1) // length - first // length + 1
                of = np.repeat(np.arange(len(n)), many)
                part = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                sequence = first[of] // length + part
                lo = np.maximum(sequence * length, first[of])
                hi = np.minimum((sequence + 1) * length, first[of] + n[of])
                data = [x + end for x in batch.column("ids").to_pylist()]
                cut = [squeezed(data[i][size * a : size * b]) for i, a, b in zip(of.tolist(), (lo - first[of]).tolist(), (hi - first[of]).tolist())]
                columns = [pa.array(permuted(sequence, total, key)), pa.array((lo - sequence * length).astype(np.int32)), batch.column("doc").take(pa.array(of)), pa.array(part), pa.array((hi - lo).astype(np.int32)), pa.array(cut, pa.binary())]
                whole_out = pa.RecordBatch.from_arrays(columns, names)
                for k in range(0, len(of), BATCH):
                    yield whole_out.slice(k, BATCH)

    fields = [("slot", T.LongType()), ("at", T.IntegerType()), ("doc_id", docs.schema[doc_id].dataType), ("part", T.LongType()), ("n_tokens", T.IntegerType()), ("ids", T.BinaryType())]
    names = [f for f, _ in fields]
    return rows.mapInArrow(run, T.StructType([T.StructField(*f) for f in fields])), total


def materialise(docs: DataFrame, path: str, ids: Ranks, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the shards, an index and a manifest to a folder; the index: (slot, shard, offset, doc_id, part, n_tokens, crc32).

    A row for each piece of a document in a sequence: n_tokens ids from `offset` on in the shard's file, with their checksum."""
    made, total = pieces(docs, ids, length, key, doc_id, text)
    shards = -(-total // per_shard)
    tasks = max(1, min(shards, partitions(docs.sparkSession)))
    stride = length * KIND.itemsize
    dealt = made.repartitionById(tasks, F.expr(f"cast(slot div {per_shard} * {tasks} div {max(shards, 1)} as int)")).sortWithinPartitions("slot", "at")
    padding = np.array([ids.padding], KIND).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(path)
        now, out, temporary, written_to = None, None, None, 0

        def close() -> None:
            if out is not None:
                out.write(padding * (-written_to % stride // KIND.itemsize))
                out.close()
                _replace(store, temporary, f"{root}/{shard_name(now)}")

        for batch in batches:
            slot, sums = batch.column("slot").to_numpy(), []
            own, offset = slot // per_shard, slot % per_shard * stride + batch.column("at").to_numpy() * KIND.itemsize
            for shard, place, piece in zip(own.tolist(), offset.tolist(), batch.column("ids")):
                if shard != now:
                    close()
                    now, written_to, temporary = shard, 0, f"{root}/.{shard_name(shard)}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(temporary)
                data = unsqueezed(piece.as_py())
                if gap := place - written_to:  # behind the stream's last sequence
                    if gap < 0 or gap >= stride:
                        raise RuntimeError(f"shard {shard} lacks ids before {place}")
                    out.write(padding * (gap // KIND.itemsize))
                out.write(data)
                written_to = place + len(data)
                sums.append(zlib.crc32(data))
            columns = [batch.column("slot"), pa.array(own), pa.array(offset), *[batch.column(c) for c in ("doc_id", "part", "n_tokens")], pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["slot", "shard", "offset", "doc_id", "part", "n_tokens", "crc32"])
        close()

    store, root = filesystem(path)
    store.create_dir(root)
    kind = dealt.schema["doc_id"].dataType.simpleString()
    index = dealt.mapInArrow(run, f"slot long, shard long, offset long, doc_id {kind}, part long, n_tokens int, crc32 long")
    index.write.parquet(f"{path}/index")
    with store.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"total": total, "length": length, "per_shard": per_shard, "type": KIND.str, "end": ids.end, "padding": ids.padding, "key": key}).encode())
    return docs.sparkSession.read.schema(index.schema).parquet(f"{path}/index")


def _replace(store: pafs.FileSystem, source: str, target: str) -> None:
    try:
        store.move(source, target)
    except OSError:  # a file system that doesn't move over a file, which another attempt left
        if store.get_file_info(target).type == pafs.FileType.NotFound:
            raise
        store.delete_file(target)
        store.move(source, target)


def resume(path: str, seen: int = 0) -> Iterator[np.ndarray]:
    """The sequences from slot `seen` on, in order, each LENGTH ids: one seek, then reads in a row; earlier shards aren't opened."""
    store, at = filesystem(path)
    with store.open_input_stream(f"{at}/manifest.json") as f:
        held = json.loads(f.read())
    stride = held["length"] * np.dtype(held["type"]).itemsize
    for shard in range(seen // held["per_shard"], -(-held["total"] // held["per_shard"])):
        first = max(seen - shard * held["per_shard"], 0)
        with store.open_input_file(f"{at}/{shard_name(shard)}") as f:
            f.seek(first * stride)
            while data := f.read(stride):
                yield np.frombuffer(data, held["type"])
