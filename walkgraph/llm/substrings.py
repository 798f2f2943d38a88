"""Substring dedup: Rabin-Karp hashes of every window of WINDOW words, counted in Spark.

A window is WINDOW consecutive words of one document; words lie between ASCII white space and
count unchanged. A word goes if a window that covers it also starts in a document with a smaller
id. Windows are judged on the input.

Every window has a rolling hash (a polynomial modulo 2**64 over hashed words, from prefix sums)
and a minimum: the least hash of the GRAM-word runs inside it. Equal windows have equal minima,
and neighbouring windows mostly share theirs, so a document has far fewer minima than windows.
Rolling hashes select candidates only. A candidate's words themselves, joined by one space, are
compared by a BLAKE2b digest of them that is part of its key, so texts made to collide under the
polynomial are told apart.

1. Neighbouring windows with the same minimum are a run, kept as a row: its minimum, a hash and
   the digest of all its words, its place. Minima are counted: only those of two or more
   documents can belong to a window that repeats across documents. This loses nothing and leaves
   few runs.
2. These runs are counted by minimum, hash and digest, with the least id of each: in every later
   document the whole run goes.
3. The first document's run of each kind stands for all of its kind. Where a minimum has several
   kinds of runs, these may share some windows: their windows are counted one by one by hash and
   digest, with the least id of each.
4. The places of windows that a smaller id has too go back to their documents, where they merge
   into maximal intervals of words to remove.

All counts add up before the shuffle, so a passage in a third of all documents is one row from
each task; every join is between two shuffles of its own, so adaptive execution can split its
hot keys. The texts are dealt by id and text hash; steps 3 and 4 use the same shuffle.

Defined cases: a null text has no words. Documents with a null id keep all words, and are no
one's smaller document; they aren't dealt. Rows with equal ids count as one document: neither is
smaller; each loses what its own text repeats. A text of fewer than WINDOW words keeps all. A
column of documents named as a result is replaced. The kept text has the white space of the text
as it was. A very long text is worked on alone, whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from walkgraph.llm.common import U64, apart, flat_words, key_of, lines_of_words, mixed, sheltered, space_table, split, with_arrow, words_in, written

WINDOW = 50
GRAM = 16
TABLE = space_table(lower=False)
SPACE = TABLE == 0x20
#: Odd bases of the polynomials over bytes and over words.
BYTE_BASE, GRAM_BASE, FIRST_BASE, COUNT_FACTOR = 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xA0761D6478BD642F

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.ones(size, U64), np.ones(size, U64)
        up[1:], down[1:] = U64(base), U64(pow(base, -1, 1 << 64))
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size <= 1 << 23:
            _POWERS[base] = have
    return have


def rolled(values: np.ndarray, base: int, width: int) -> np.ndarray:
    """The polynomial hash of every run of `width` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[width:] - sums[:n]) * down[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    up, down = _powers(BYTE_BASE, len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data + U64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[stops] - sums[starts]) * down[starts])


def minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every run of `width` values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class Windows:
    """The windows of texts: of each its minimum, its text, its first word in it (place) and among all words (at)."""

    def __init__(self, texts: pa.Array, window: int, gram: int):
        line, ends = lines_of_words(texts, TABLE)
        self._starts, self._stops, first = words_in(line, ends)
        self._line, self.window = line.tobytes(), window
        self.hashed = word_hashes(line, self._starts, self._stops)
        n = np.maximum(np.diff(first) - window + 1, 0)
        self.text = np.repeat(np.arange(len(n)), n)
        self.place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.at = self.place + np.repeat(first[:-1], n)
        least = minima(mixed(rolled(self.hashed, GRAM_BASE, gram)), window - gram + 1) if self.at.size else np.zeros(0, U64)
        self.least = least[self.at]

    def digests(self, which: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """A digest of the words that n windows from each of `which` on cover."""
        begin, stop = self._starts[self.at[which]], self._stops[self.at[which] + n + self.window - 2]
        line, blake = self._line, hashlib.blake2b
        out = b"".join([blake(line[a:b], digest_size=8).digest() for a, b in zip(begin.tolist(), stop.tolist())])
        return np.frombuffer(out, np.int64)


def _runs(docs: DataFrame, doc_id: str, text: str, window: int, gram: int) -> DataFrame:
    """(m, r, c, d, t, p, n): the runs of windows with the same minimum m.

    r is a hash of the run's words and c their digest, t a hash of its text, p its first word and n its count of windows."""

    def run(batches):
        for batch in batches:
            for part in split(batch, text):
                w = Windows(part.column(text), window, gram)
                new = np.ones(len(w.at), bool)
                new[1:] = (w.least[1:] != w.least[:-1]) | (w.text[1:] != w.text[:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(w.at)))
                up, down = _powers(FIRST_BASE, len(w.hashed) + 1)
                sums = np.zeros(len(w.hashed) + 1, U64)
                np.cumsum(w.hashed * up[: len(w.hashed)], out=sums[1:])
                begin, of = w.at[first], pa.array(w.text[first])
                r = mixed((sums[begin + n + window - 1] - sums[begin]) * down[begin] + n.astype(U64) * U64(COUNT_FACTOR))
                columns = [pa.array(w.least[first].view(np.int64)), pa.array(r.view(np.int64)), pa.array(w.digests(first, n)), part.column(doc_id).take(of), part.column("__t").take(of), pa.array(w.place[first].astype(np.int32)), pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["m", "r", "c", "d", "t", "p", "n"])

    fields = [("m", T.LongType()), ("r", T.LongType()), ("c", T.LongType()), ("d", docs.schema[doc_id].dataType), ("t", T.LongType()), ("p", T.IntegerType()), ("n", T.IntegerType())]
    rows = docs.where(F.col(doc_id).isNotNull()).select(doc_id, text, F.xxhash64(text).alias("__t"))
    return rows.mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))


def _single(joined: DataFrame, doc_id: str, text: str, window: int, gram: int) -> DataFrame:
    """(h, c, d, t, p) of the windows that `__at`, a list of (first word, count) of the document's runs, names."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("__at")))
            for part in split(batch, text):
                w = Windows(part.column(text), window, gram)
                named = part.column("__at")
                rows = np.repeat(np.arange(part.num_rows), named.value_lengths().to_numpy(zero_copy_only=False))
                both = named.flatten()
                p, n = both.field("p").to_numpy(zero_copy_only=False), both.field("n").to_numpy(zero_copy_only=False)
                begin = np.searchsorted(w.text, np.arange(part.num_rows))
                hit = np.unique(np.repeat(begin[rows] + p - np.cumsum(n) + n, n) + np.arange(n.sum()))
                h = mixed(rolled(w.hashed, FIRST_BASE, window))[w.at[hit]]
                of = pa.array(w.text[hit])
                columns = [pa.array(h.view(np.int64)), pa.array(w.digests(hit, 1)), part.column(doc_id).take(of), part.column("__t").take(of), pa.array(w.place[hit].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["h", "c", "d", "t", "p"])

    fields = [("h", T.LongType()), ("c", T.LongType()), ("d", joined.schema[doc_id].dataType), ("t", T.LongType()), ("p", T.IntegerType())]
    return joined.mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))


def _least(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The least d of each key, in columns that a join has to deal anew: then both of its sides are shuffles, which it may split."""
    found = rows.groupBy(*keys).agg(F.min("d").alias("least"), F.max("d").alias("most")).where("least < most")
    return found.select(*[F.col(k).bitwiseXOR(F.lit(-1)).alias(f"__{k}") for k in keys], "least")


def _later(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of which a smaller d has the same key."""
    same = [F.col(k).bitwiseXOR(F.lit(-1)) == F.col(f"__{k}") for k in keys]
    return rows.join(_least(rows, keys), same).where("d > least")


SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
ADDED = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("removed_spans", SPANS),
    T.StructField("kept_text", T.StringType()),
    T.StructField("kept_sha256", T.StringType()),
]


def _merged(places: list, n_words: int, window: int) -> list[tuple[int, int]]:
    """Maximal intervals of the words that the windows (first p, count n) cover."""
    out: list[tuple[int, int]] = []
    for p, n in sorted((x["p"], x["n"]) for x in places):
        stop = min(p + n + window - 1, n_words)
        if out and p <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        elif p < stop:
            out.append((p, stop))
    return out


def _cut(batch: pa.RecordBatch, text: str, window: int, texts: bool) -> list[pa.Array]:
    line, ends = lines_of_words(batch.column(text), TABLE)
    begins, stops, first = words_in(line, ends)
    joined, n_words = memoryview(line), np.diff(first)
    if texts:
        data, at, starts, _, _ = flat_words(batch.column(text), SPACE)
        whole = data.tobytes()
    n_removed, spans, kept, digests = [], [], [], []
    for i, places in enumerate(batch.column("__ps").to_pylist()):
        own = _merged(places, int(n_words[i]), window) if places else []
        # Kept words between removed intervals, each piece with the spaces inside it.
        cuts = [0, *(x for ab in own for x in ab), int(n_words[i])]
        pieces = [(first[i] + a, first[i] + b) for a, b in zip(cuts[::2], cuts[1::2]) if a < b]
        digest = hashlib.sha256()
        for k, (a, b) in enumerate(pieces):
            digest.update(b" " if k else b"")
            digest.update(joined[begins[a] : stops[b - 1]])
        digests.append(digest.hexdigest())
        n_removed.append(sum(b - a for a, b in own))
        spans.append([{"first": a, "stop": b} for a, b in own])
        raw = None
        if texts:
            raw = whole[at[i] : at[i + 1]]
            if own:
                begin, parts = 0, []
                for a, b in own:
                    parts.append(raw[begin : starts[first[i] + a] - at[i]])
                    begin = starts[first[i] + b] - at[i] if b < n_words[i] else len(raw)
                raw = b"".join([*parts, raw[begin:]])
            raw = raw.decode()
        kept.append(raw)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))
    return [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string()), pa.array(digests, pa.string())]


def dedup(docs: DataFrame, carry: list[str] | None = None, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, texts: bool = True) -> DataFrame:
    """documents with n_words, n_removed, removed_spans (of words: first, one past the last), kept_text and kept_sha256.

    carry names the columns to have in the result (all by default); texts=False leaves kept_text null."""
    gram = min(gram, window)
    names = [f.name for f in ADDED]
    kept = [c for c in (docs.columns if carry is None else carry) if c not in names]
    every = written(_runs(docs, doc_id, text, window, gram))
    turned = F.col("m").bitwiseXOR(F.lit(-1))
    common = every.groupBy("m").agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a < b").select(turned.alias("__m"))
    runs = written(every.join(common, turned == F.col("__m"), "left_semi"))
    base = docs.select(*kept, *[c for c in (doc_id, text) if c not in kept])
    # Rows of one id may have different texts.
    known = base.where(F.col(doc_id).isNotNull()).withColumn("__t", F.xxhash64(text)).withColumn("__key", key_of(doc_id, "__t"))
    kinds = runs.groupBy("m", "r", "c").agg(F.min("d").alias("d"))
    several = kinds.groupBy("m").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(turned.alias("__m"))
    first = kinds.join(several, turned == F.col("__m"), "left_semi")
    stand = runs.join(first, ["m", "r", "c", "d"]).groupBy("d", "t").agg(F.collect_set(F.struct("p", "n")).alias("__at"))
    # An outer join leaves the shuffle of the texts as it is below, so that it is used again.
    single = _single(_met(known, stand), doc_id, text, window, gram)
    gone = _later(runs, ["m", "r", "c"]).select("d", "t", "p", "n").unionByName(_later(single, ["h", "c"]).select("d", "t", "p", F.lit(1).alias("n")))
    places = gone.groupBy("d", "t").agg(F.collect_list(F.struct("p", "n")).alias("__ps"))
    marked = _met(known, places)  # with __t: without it the shuffle would be another one
    unknown = base.where(F.col(doc_id).isNull()).withColumn("__t", F.lit(0).cast("long")).withColumn("__ps", F.lit(None).cast(marked.schema["__ps"].dataType))
    return with_arrow(marked.unionByName(unknown), ADDED, lambda batch: _cut(batch, text, window, texts), kept, text)


def _met(known: DataFrame, lists: DataFrame) -> DataFrame:
    """The documents with their row, if any, of lists (d, t, ...)."""
    return known.join(apart(lists, ["d", "t"], "__of"), F.col("__key") == F.col("__of"), "left").drop("__of", "__key")


def shortened(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their texts shortened, and n_chars, if they have it, of the shortened texts."""
    inside, back = sheltered(docs, [f.name for f in ADDED])
    out = dedup(inside, None, doc_id, text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return back(out.withColumn(text, F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(text))))


def brute(docs: list[tuple], window: int = WINDOW) -> list[tuple]:
    """For tests: (doc_id, n_words, n_removed, kept_sha256)."""
    cut = [(name, (t or "").encode().split()) for name, t in docs]
    least: dict[tuple, int] = {}
    for name, w in cut:
        for i in range(len(w) - window + 1):
            if name is not None:
                k = tuple(w[i : i + window])
                least[k] = min(name, least.get(k, name))
    out = []
    for name, w in cut:
        gone = set()
        for i in range(len(w) - window + 1):
            if name is not None and least[tuple(w[i : i + window])] < name:
                gone.update(range(i, i + window))
        rest = [x for i, x in enumerate(w) if i not in gone]
        out.append((name, len(w), len(gone), hashlib.sha256(b" ".join(rest)).hexdigest()))
    return out
