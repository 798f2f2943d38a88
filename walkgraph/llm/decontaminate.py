"""Benchmark decontamination by Wu-Manber search for windows of benchmark words in documents.

A word is a run of digits, letters a-z (A-Z are lower-cased) and characters beyond ASCII. A
window is WINDOW consecutive words of one benchmark item; an item with fewer words, but not
none, is one window. Texts become lines ' word word ... ' of bytes, so a window is a byte
string ' w1 w2 ... ' that is found at whole words only. The search is Wu and Manber's: windows
of like length share tables; a table gives, for the hash of the last bytes before a position,
how far the search may skip; where it may not skip, the bucket of that block together with the
window's first bytes selects the strings to test, and these are compared byte by byte.

Defined cases: a null or empty text has no words, no hits and the digest of no items. An item
without words has no window. An item with a null id marks hits but is in no list of items;
rows with equal ids are one item. Repeated documents are each judged. A column of documents
named as a result is replaced.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from walkgraph.llm.common import END, U64, lines_of_words, sheltered, with_arrow, without

WINDOW = 13
#: Benchmark bytes in one set of tables, which each Python worker holds. A larger benchmark is
#: searched for in several sets, one after the other.
BLOCK_BYTES = 4 << 20
#: Least lengths of the groups of windows, and the bytes that a block of the group has.
GROUPS = ((32, 8), (16, 6), (8, 4), (3, 2))
LANE = 4096
MULTIPLIER = U64(0x9E3779B97F4A7C15)


def word_table() -> np.ndarray:
    table = np.full(256, 0x20, np.uint8)
    table[128:] = np.arange(128, 256)
    for first, last, to in ((48, 57, 48), (97, 122, 97), (65, 90, 97)):
        table[first : last + 1] = np.arange(to, to + last - first + 1)
    return table


TABLE = word_table()


def windows(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> dict[bytes, set[str | None]]:
    """The byte strings to look for, each with its items' ids."""
    found: dict[bytes, set[str | None]] = defaultdict(set)
    if not items:
        return found
    line, ends = lines_of_words(pa.array([t for _, t in items], pa.string()), TABLE)
    data, begin = line.tobytes(), 0
    for (name, _), end in zip(items, ends):
        words = data[begin:end].split()
        begin = int(end) + 1
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found[b" " + b" ".join(words[i : i + window]) + b" "].add(name)
    return found


class _Group:
    """The tables for windows of at least `least` bytes."""

    def __init__(self, strings: list[bytes], block: int):
        self.least = least = min(map(len, strings))
        self.block = min(block, least)
        self.strings = strings
        joined = np.frombuffer(b"".join(s[:least] for s in strings), np.uint8).reshape(len(strings), least)
        self.bits = int(min(22, max(12, (joined.size * 8).bit_length())))
        self.shift = np.full(1 << self.bits, min(255, least - self.block + 1), np.uint8)
        padded = np.zeros((len(strings), least + 8), np.uint8)
        padded[:, 8:] = joined
        for end in range(self.block, least + 1):
            at = self._slot(self._block(np.ascontiguousarray(padded[:, end : end + 8]).view("<u8")[:, 0]))
            self.shift[at] = np.minimum(self.shift[at], min(255, least - end))
        last = self._block(np.ascontiguousarray(padded[:, least : least + 8]).view("<u8")[:, 0])
        head = np.zeros((len(strings), 8), np.uint8)
        head[:, : min(8, least)] = joined[:, :8]
        self.mask = U64((1 << (8 * min(8, least))) - 1)
        key = self._key(last, head.view("<u8")[:, 0])
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def _block(self, eight: np.ndarray) -> np.ndarray:
        return eight >> U64(8 * (8 - self.block))

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return ((block * MULTIPLIER) >> U64(64 - self.bits)).astype(np.int64)

    def _key(self, block: np.ndarray, head: np.ndarray) -> np.ndarray:
        return (block ^ (head * U64(0xD6E8FEB86659FD93))) * MULTIPLIER

    def search(self, line: np.ndarray, eights: np.ndarray, data: bytes) -> list[tuple[int, int]]:
        """Places and numbers of strings. line has 8 bytes before the text and 8 after it; eights its 8-byte numbers."""
        size = len(line) - 16
        if size < self.least:
            return []
        at = np.arange(self.least, size + 1, LANE, dtype=np.int64)  # ends of windows, one past, in the text
        until = np.minimum(at + LANE, size + 1)
        stops = []
        while at.size:
            slot = self._slot(self._block(eights[at]))
            skip = self.shift[slot]
            if (still := skip == 0).any():
                stops.append(at[still])
            at = at + np.maximum(skip, 1)
            live = at < until
            at, until = at[live], until[live]
        if not stops:
            return []
        stop = np.concatenate(stops)
        start = stop - self.least
        key = self._key(self._block(eights[stop]), eights[start + 8] & self.mask)
        lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        out = []
        for k in np.flatnonzero(hi > lo):
            for j in self.order[lo[k] : hi[k]]:
                s = self.strings[j]
                if data[start[k] + 8 : start[k] + 8 + len(s)] == s:
                    out.append((int(start[k]), int(j)))
        return out


class Searcher:
    """Finds all occurrences of windows in texts."""

    def __init__(self, found: dict[bytes, set[str | None]]):
        self.groups = []
        rest = sorted(found)
        for least, block in GROUPS:
            if some := [s for s in rest if len(s) >= least]:
                self.groups.append((_Group(some, block), [found[s] for s in some], np.array([s.count(b" ") - 1 for s in some])))
                rest = [s for s in rest if len(s) < least]

    def scan(self, texts: pa.Array) -> list[tuple[int, list[tuple[int, int]], set[str | None]]]:
        """For each text the count of words, hit spans (first word, one past the last) and items."""
        line, ends = lines_of_words(texts, TABLE)
        padded = np.zeros(len(line) + 16, np.uint8)
        padded[8:-8] = line
        eights = np.ndarray(len(line) + 9, "<u8", padded.data, 0, (1,))
        spaces = np.flatnonzero((line[:-1] == 0x20) & (line[1:] != END)) if len(line) else np.zeros(0, np.int64)
        first = np.concatenate([[0], np.searchsorted(spaces, ends)])
        out = [(int(n), [], set()) for n in np.diff(first)]
        data = padded.tobytes()
        for group, items, sizes in self.groups:
            for place, j in group.search(padded, eights, data):
                doc = int(np.searchsorted(ends, place))
                word = int(np.searchsorted(spaces, place)) - int(first[doc])
                out[doc][1].append((word, word + int(sizes[j])))
                out[doc][2].update(items[j])
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("stop", T.LongType())]))
ADDED = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", SPANS),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]

JUDGED = ["n_hit", "n_items", "items_sha256", "contaminated"]


def _blocks(benchmark: DataFrame, item: str, text: str) -> list[DataFrame]:
    # Equal rows would all be dealt to one block.
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).distinct()
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = int(size) // BLOCK_BYTES + 1
    dealt = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [rows.where(dealt == k) if n > 1 else rows for k in range(n)]


def find(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """documents with n_words, hit_spans (of words, merged, sorted) and hit_items (sorted ids)."""
    spark, out = docs.sparkSession, docs
    kept = [c for c in (docs.columns if carry is None else carry) if c not in {f.name for f in ADDED}]
    out = without(docs, [f.name for f in ADDED])
    blocks = _blocks(benchmark, item, text)
    for k, block in enumerate(blocks):
        strings = spark.sparkContext.broadcast(dict(windows([tuple(r) for r in block.collect()], window)))
        earlier = k > 0

        def work(batch: pa.RecordBatch, strings=strings, earlier=earlier) -> list[pa.Array]:
            found = _searcher(strings).scan(batch.column(text))
            was = batch.column("hit_spans").to_pylist() if earlier else [[]] * len(found)
            had = batch.column("hit_items").to_pylist() if earlier else [[]] * len(found)
            spans = [merged(s + [(x["first"], x["stop"]) for x in o]) for (_, s, _), o in zip(found, was, strict=True)]
            return [
                pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([[{"first": a, "stop": b} for a, b in s] for s in spans], pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))),
                pa.array([sorted({x for x in i if x is not None} | set(o)) for (_, _, i), o in zip(found, had, strict=True)], pa.list_(pa.string())),
            ]

        last = k == len(blocks) - 1
        out = _step(out, work, kept + ([] if last or text in kept else [text]), text, earlier)
    return out.select(*kept, *[f.name for f in ADDED])


def _step(docs: DataFrame, work, carry: list[str], text: str, earlier: bool) -> DataFrame:
    if not earlier:
        return with_arrow(docs, ADDED, work, carry, text)
    names = {f.name: f"__{f.name}" for f in ADDED[1:]}
    before = docs.withColumnsRenamed(names).drop("n_words")

    def inner(batch: pa.RecordBatch) -> list[pa.Array]:
        back = {v: k for k, v in names.items()}
        return work(batch.rename_columns([back.get(c, c) for c in batch.schema.names]))

    return with_arrow(before, ADDED, inner, carry, text)


_HELD: list = [None, None]


def _searcher(strings) -> Searcher:
    """Each Python worker builds the tables of a broadcast once."""
    if _HELD[0] is not strings.value:
        _HELD[:] = [strings.value, Searcher(strings.value)]
    return _HELD[1]


def judge(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None, **names) -> DataFrame:
    """find(), and from it n_hit, n_items, items_sha256 and contaminated (a twentieth of the words or more are hit)."""
    kept = [c for c in (docs.columns if carry is None else carry) if c not in JUDGED]
    found = find(docs, benchmark, kept, **names)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["first"])
    found = found.withColumn("n_hit", hit).withColumn("n_items", F.size("hit_items").cast("long"))
    found = found.withColumn("items_sha256", F.sha2(F.concat_ws(",", "hit_items"), 256))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, as they were."""
    inside, back = sheltered(docs, [f.name for f in ADDED] + JUDGED)
    return back(judge(inside, benchmark).where(~F.col("contaminated")))


def brute(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """For tests: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    import re

    def cut(t: str | None) -> list[str]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    found = defaultdict(set)
    for name, t in items:
        w = cut(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            found[tuple(w[i : i + window])].add(name)
    out = []
    for name, t in docs:
        w, hit, ids = cut(t), set(), set()
        for k in {len(x) for x in found}:
            for i in range(len(w) - k + 1):
                if (x := tuple(w[i : i + k])) in found:
                    hit.update(range(i, i + k))
                    ids |= found[x]
        ids = sorted(str(x) for x in ids if x is not None)
        out.append((name, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out
