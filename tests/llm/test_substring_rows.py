"""Rows of one id with different long texts lose only what repeats in their own text."""

import random

import duckdb

from walkgraph.llm import substrings
from walkgraph.llm.queries import OP4_SQL


def test_rows_of_one_id(spark):
    rng = random.Random(3)
    some = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, other = some(70), some(60)
    docs = [(1, passage), (2, f"{some(20)} {passage} {other}"), (7, f"{some(10)} {passage} {some(30)}"), (7, some(200)), (7, f"{other} {some(90)}"), (9, some(120))]
    out = substrings.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    want = sorted(substrings.brute(docs), key=str)
    assert sorted((tuple(r) for r in out.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str) == want
    assert sorted(r[2] for r in want if r[0] == 7) == [0, 60, 70]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    assert sorted(con.sql(OP4_SQL).fetchall(), key=str) == want


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_that_collide_under_every_odd_base(spark):
    """The Thue-Morse string and its complement are equal under a polynomial modulo 2 ** 64 with any odd base."""
    word = thue_morse(2048)
    other = word.translate(str.maketrans("ab", "ba"))
    before, after = (" ".join(f"{k}{i}" for i in range(30)) for k in "xy")
    docs = [(1, f"{before} {word} {after}"), (2, f"{before} {other} {after}"), (3, f"{before} {other} {after}")]
    import numpy as np

    data = np.frombuffer(f"{word} {other}".encode(), np.uint8)
    starts, stops = np.array([0, len(word) + 1]), np.array([len(word), len(data)])
    same = substrings.word_hashes(data, starts, stops)
    assert same[0] == same[1]
    out = substrings.dedup(spark.createDataFrame(docs, "doc_id long, text string"))
    got = sorted(tuple(r) for r in out.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == sorted(substrings.brute(docs)) and [r[2] for r in got] == [0, 0, 61]


def test_null_and_repeated_rows(spark):
    rng = random.Random(5)
    passage = " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    docs = [(None, passage)] * 20 + [(4, passage)] * 20 + [(2, passage), (None, None), (None, "")]
    out = substrings.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    got = sorted((tuple(r) for r in out.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    assert got == sorted(substrings.brute(docs), key=str)


def test_a_text_beyond_a_chunk(spark):
    """One text of over CHUNK_BYTES, whose last words an earlier document has."""
    from walkgraph.llm import common

    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(10**7)}" for _ in range(280_000))
    assert len(long) > common.CHUNK_BYTES
    docs = [(5, long), (1, " ".join(long.split()[-70:])), (6, "x " + long[: 10**6]), (7, "short")]
    out = substrings.dedup(spark.createDataFrame(docs, "doc_id long, text string"))
    got = sorted(tuple(r) for r in out.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == sorted(substrings.brute(docs))
