"""Packing: optimal length buckets, and batches of a token budget inside each.

A document's tokens are the ids of its text by a rank file; without one, its words between ASCII
white space, or the numbers of a column that the caller names. A document of more than MAX_LENGTH
tokens becomes several sequences of at most so many; none is cut off. The histogram of all
sequences' lengths, at most MAX_LENGTH + 1 rows, comes to the driver, where dynamic programming
chooses the BUCKETS upper bounds with the least padding in total. Each bucket's sequences, in the
order of a hash, fill batches of BUDGET / bound sequences: a batch has at most BUDGET tokens with
its padding, and only a bucket's last batch may have fewer sequences. With a rank file each
sequence has its ids, two bytes each, little-endian.

Texts are read once: their ids, or counts, are kept as a table in the shared folder. A bucket may
hold any share of the rows: its sequences are numbered over ranges, not in a task.

Defined cases: a document without tokens is one sequence of length 0. Documents of null ids and
repeated rows are packed like others, in any order among themselves. No documents: no rows. A
column of documents named as a result is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkgraph.llm.common import numbered, written
from walkgraph.llm.encoding import KIND, Ranks, with_ids

MAX_LENGTH = 2048
BUCKETS = 16
BUDGET = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
RESULT = ["piece", "start", "length", "bucket", "bucket_length", "batch", "slot", "token_ids"]


def bounds(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most so many buckets with the least padding; each is a length that occurs."""
    lengths = np.array(sorted(histogram), np.int64)
    if not lengths.size:
        return []
    counts = np.array([histogram[int(x)] for x in lengths], np.float64)
    upto = np.concatenate([[0.0], np.cumsum(counts)])
    best = np.full(len(lengths) + 1, np.inf)
    best[0] = 0
    cuts = []
    # Padded tokens of lengths i to j - 1 in one bucket; the tokens themselves don't depend on the cuts.
    place = np.arange(len(upto))
    one = np.where(place[:, None] < place, (upto - upto[:, None]) * np.concatenate([[0], lengths]), np.inf)
    for _ in range(min(buckets, len(lengths))):
        cost = best[:, None] + one
        cuts.append(np.argmin(cost, axis=0))
        best = cost.min(axis=0)
        best[0] = 0
    out, j = [], len(lengths)
    for cut in reversed(cuts):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(cut[j])
    return out[::-1]


def pack(docs: DataFrame, carry: list[str] | None = None, length: str | None = None, ids: Ranks | None = None, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, budget: int = BUDGET, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each sequence: the carried columns (doc_id by default), piece, start and length (in tokens), bucket, bucket_length, batch, slot, and token_ids if there is a rank file."""
    if budget < max_length:
        raise ValueError("a batch must have room for the longest sequence")
    kept = [c for c in ([doc_id] if carry is None else carry) if c not in RESULT]
    if ids:
        rows = with_ids(docs.withColumn("__order", F.col(doc_id)), ids, [*kept, "__order"], text)
    else:
        n = F.col(length).cast("long") if length else F.regexp_count(F.col(text), F.lit(WORD)).cast("long")
        rows = docs.select(*kept, F.col(doc_id).alias("__order"), F.coalesce(n, F.lit(0).cast("long")).alias("__n"))
    rows = written(rows.withColumn("__row", F.monotonically_increasing_id()))
    pieces = F.sequence(F.lit(0).cast("long"), F.greatest(F.expr(f"(__n - 1) div {max_length}"), F.lit(0).cast("long")))
    made = rows.select(*kept, "__order", "__row", "__n", F.explode(pieces).alias("piece"))
    made = made.withColumn("start", F.col("piece") * max_length)
    made = made.withColumn("length", F.least(F.col("__n") - F.col("start"), F.lit(max_length))).drop("__n")
    found = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}  # at most max_length + 1 rows
    tops = bounds(found, buckets)
    listed = F.array(*[F.lit(b).cast("long") for b in tops]) if tops else F.array(F.lit(max_length).cast("long"))
    made = made.withColumn("bucket", F.size(F.filter(listed, lambda b: b < F.col("length"))))
    made = made.withColumn("__hash", F.xxhash64("__order", "piece"))
    made, _ = numbered(made, ["__hash", "__order", "piece"], "__rank", "bucket")
    made = made.withColumn("bucket_length", F.element_at(listed, F.col("bucket") + 1))
    made = made.withColumn("__room", F.expr(f"{budget} div greatest(bucket_length, 1)"))
    places = [*kept, "piece", "start", "length", "bucket", "bucket_length", F.expr("__rank div __room").alias("batch"), (F.col("__rank") % F.col("__room")).alias("slot")]
    if ids is None:
        return made.select(*places)
    # The numbers meet the ids once they are known; a row's number is its own, so no key is hot.
    cut = F.substring("__ids", (F.col("start") * KIND.itemsize + 1).cast("int"), (F.col("length") * KIND.itemsize).cast("int"))
    return made.join(rows.select("__row", "__ids"), "__row").select(*places, cut.alias("token_ids"))
