"""SimHash near-duplicates: 64-bit fingerprints linked within 2 bits by covering locality-sensitive hashing.

Fingerprint: A-Z lower-cased, words between ASCII white space, XXH64 (seed 42) of each run of
3 words joined by a space, repeats included; a text of fewer words is one run. A bit is 1 if it
is set in more than half of the hashes. A text without words has the fingerprint zero.

Linking works on distinct fingerprints, each with its least doc_id, so that copies cost nothing.
Each bit has a random vector of RADIUS + 1 bits; for each non-zero vector v there is a table
whose mask holds the bits with an odd product with v. Two fingerprints that differ in RADIUS bits
or fewer have some v that is orthogonal to all of these bits' vectors, so in v's table they
agree in every masked bit: each pair within the radius collides in some table. Buckets with up
to SMALL fingerprints are compared pair by pair. In a larger bucket, each fingerprint goes to
itself and to its neighbours at one bit (outside the mask): two fingerprints are within 2 bits
exactly if they meet at one of these, and those that meet at one are linked to the least of
them, so a bucket of n fingerprints has links in proportion to n, none of them false or lost.
Components of the links come from large-star and small-star rounds over tables in the shared
folder; nothing is collected.

Defined cases: null, empty and blank texts share the fingerprint zero and are linked. Rows with
equal ids are each returned. Null ids count in no minimum; a component of null ids has a null
component_id. A column of documents named as a result is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from walkgraph.llm.common import apart, checkpointed, key_of, lines_of_words, sheltered, space_table, with_arrow, without, words_in, written

RADIUS = 2
SHINGLE = 3
SMALL = 32
#: From this seed each bit draws its vector.
SEED = 7
TABLE = space_table(lower=True)


def hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle, and where each text's shingles begin, with one end more."""
    line, ends = lines_of_words(texts, TABLE)
    starts, stops, first = words_in(line, ends)
    count = np.diff(first)
    n = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    at = np.concatenate([[0], np.cumsum(n)])
    word = np.repeat(first[:-1] - at[:-1], n) + np.arange(at[-1])
    last = np.minimum(word + SHINGLE, np.repeat(first[1:], n)) - 1
    data, digest = line.tobytes(), xxhash.xxh64_intdigest
    out = [digest(data[a:b], 42) for a, b in zip(starts[word].tolist(), stops[last].tolist())]
    return np.array(out, np.uint64), at


def fingerprints(texts: pa.Array) -> np.ndarray:
    found, at = hashes(texts)
    n = np.diff(at)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if some.size:
        bits = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, at[:-1][some], axis=0, dtype=np.uint32)
        major = (2 * sums > n[some, None]).astype(np.uint8)
        out[some] = np.packbits(major, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def with_fingerprint(docs: DataFrame, carry: list[str] | None = None, text: str = "text") -> DataFrame:
    """documents with `simhash`, the fingerprint as a signed number."""

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(fingerprints(batch.column(text)).view(np.int64))]

    return with_arrow(docs, [T.StructField("simhash", T.LongType())], work, carry, text)


def masks(radius: int = RADIUS, seed: int = SEED) -> list[int]:
    """One mask of 64 bits for each non-zero vector of radius + 1 bits."""
    draw = np.random.default_rng(seed).permutation(np.arange(64) % (1 << (radius + 1)))
    return [sum(1 << i for i, x in enumerate(draw) if (int(x) & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct values of `simhash` within RADIUS bits: all of these are joined by paths of links."""
    table = F.array(*[F.struct(F.lit(k).alias("t"), F.col("simhash").bitwiseAND(F.lit(signed(m))).alias("key")) for k, m in enumerate(masks())])
    dealt = prints.select("simhash", F.inline(table).alias("t", "key"))
    sizes = apart(dealt.groupBy("t", "key").count().where("count > 1"), ["t", "key"], "__of")
    shared = dealt.join(sizes, key_of("t", "key") == F.col("__of")).drop("__of")
    near: Column = F.transform(
        "s", lambda x, i: F.transform(
            F.filter("s", lambda y, j: (j > i) & (F.bit_count(x.bitwiseXOR(y)) <= RADIUS)), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    small = shared.where(F.col("count") <= SMALL).groupBy("t", "key").agg(F.collect_list("simhash").alias("s"))
    pairs = small.select(F.explode(F.flatten(near)).alias("e")).select("e.*")
    free = F.array(*[F.array(*[F.lit(0)] + [F.lit(signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in masks()])
    hop = shared.where(F.col("count") > SMALL).select("t", "simhash", F.explode(F.element_at(free, F.col("t") + 1)).alias("flip"))
    met = hop.select("t", "simhash", F.col("simhash").bitwiseXOR(F.col("flip")).alias("at"))
    least = met.groupBy("t", "at").agg(F.min("simhash").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = met.join(least, ["t", "at"]).where("simhash <> least").select(F.col("least").alias("a"), F.col("simhash").alias("b"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b), a <> b; the root is the least node of its component.

    Alternates large-star and small-star rounds until a round changes nothing."""
    now = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or tuple(state) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = tuple(state)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A hub's neighbours are one key, which each join has to be free to split.
        least = apart(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), ["u"], "__of")
        large = both.where("v > u").join(least, key_of("u") == F.col("__of")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(apart(low, ["u"], "__of"), key_of("u") == F.col("__of"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")
        now = checkpointed(small.distinct())


def grouped(prints: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(simhash, root, component_id) of every distinct fingerprint in a table of (doc_id, simhash)."""
    least = prints.groupBy("simhash").agg(F.min(doc_id).alias("__least"))
    roots = components(links(least.select("simhash")))
    rooted = least.join(roots, least["simhash"] == roots["node"], "left").select(
        "simhash", F.coalesce("root", "simhash").alias("root"), "__least")
    whole = apart(rooted.groupBy("root").agg(F.min("__least").alias("component_id")), ["root"], "__of")
    return rooted.drop("__least").join(whole, key_of("root") == F.col("__of")).drop("__of")


def near_duplicates(docs: DataFrame, carry: list[str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """documents with fingerprint (16 hex digits) and component_id (the least doc_id that links reach)."""
    prints = with_fingerprint(docs, carry, text)
    kept = checkpointed(prints)
    groups = grouped(kept.select(F.col(doc_id), "simhash"), doc_id)
    base = without(kept, ["fingerprint", "component_id", "root"])
    out = base.join(groups.select("simhash", "component_id"), "simhash")
    hexed = F.lower(F.lpad(F.hex("simhash"), 16, "0"))
    return out.withColumn("fingerprint", hexed).select(*[c for c in base.columns if c != "simhash"], "fingerprint", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, one of each group: of its least doc_id and, of rows that share this, one.

    The documents are kept with their fingerprints, which are made once."""
    inside, back = sheltered(docs, ["simhash"])
    marked = written(with_fingerprint(inside, None, text))
    members = marked.select(doc_id, "simhash")
    groups = grouped(members, doc_id)
    rows = members.groupBy(doc_id, "simhash").agg(F.count(F.lit(1)).alias("n")).join(groups, "simhash")
    best = rows.where(F.col(doc_id).eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct(doc_id, "simhash", "n")).alias("s"))
    best = checkpointed(best.select(F.col(f"s.{doc_id}").alias("__id"), F.col("s.simhash").alias("__print"), F.col("s.n").alias("__n")))
    chosen = marked.join(best, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("simhash") == F.col("__print")))
    if best.where("__n > 1").isEmpty():
        return back(chosen)
    return back(chosen.where("__n = 1").unionByName(chosen.where("__n > 1").dropDuplicates(["__print", doc_id])))


def brute(docs: list[tuple]) -> list[tuple]:
    """For tests: (doc_id, fingerprint, component_id)."""
    import re

    prints = []
    for _, t in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        s = [" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    own = list(range(len(docs)))

    def top(i: int) -> int:
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= RADIUS:
                own[top(i)] = top(j)
    least: dict[int, int | None] = {}
    for i, (name, _) in enumerate(docs):
        if name is not None:
            least[top(i)] = min(name, least.get(top(i), name))
    return [(name, f"{prints[i]:016x}", least.get(top(i))) for i, (name, _) in enumerate(docs)]
