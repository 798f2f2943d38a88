"""The pipeline's stages, each against brute force on its own input, and the queries against their SQL."""

import random
import re
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
from walkgraph.llm import common, decontaminate, quality, queries, simhash, substrings


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = common.written(stage(spark, docs, data))
        after = {r["doc_id"]: r["text"] for r in docs.collect()} if "text" in docs.columns else {}
        pairs = sorted(before.items())
        if name == "quality rules":
            judged = {r["doc_id"]: r["kept"] for r in quality.judge(spark.read.parquet(f"{data}/documents.parquet")).collect()}
            assert set(after) == {d for d, k in judged.items() if k}
        elif name == "near duplicates":
            assert set(after) == {c for _, _, c in simhash.brute(pairs)}
        elif name == "substring dedup":
            assert set(after) == set(before)
            import hashlib

            for d, _, _, digest in substrings.brute(pairs):
                assert hashlib.sha256(b" ".join((after[d] or "").encode().split())).hexdigest() == digest
        elif name == "decontamination":
            assert set(after) == {r[0] for r in decontaminate.brute(pairs, bench) if not r[5]}
        else:
            assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == set(before)
            assert docs.groupBy("bucket", "batch", "slot").count().where("count > 1").isEmpty()
            break
        assert docs.columns == columns


def brute_run(rows, bench):
    """(doc_id, piece, ids) of the pipeline's result, stage by stage, by other code than the operators'."""
    from test_operators import own_ids, quality_brute

    figures = {k: quality_brute(t) for k, (_, t, _) in enumerate(rows)}
    soft = {}
    for k, (_, t, _) in enumerate(rows):
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        soft[k] = 10 * figures[k][2] > figures[k][0] or 2 * figures[k][3] > len(lines)
    hosts = {}
    for k, (_, _, s) in enumerate(rows):
        n, bad = hosts.get(s, (0, 0))
        hosts[s] = (n + 1, bad + (figures[k][5] or soft[k]))
    rates = [b / n for n, b in hosts.values()]
    mean = sum(rates) / max(len(rates), 1)
    spread, strength = mean * (1 - mean), 0.0
    if spread > 0 and len(rates) > 1:
        inverse = sum(1 / n for n, _ in hosts.values()) / len(rates)
        variance = sum((x - mean) ** 2 for x in rates) / (len(rates) - 1)
        strength = max(spread / max((variance - spread * inverse) / max(1 - inverse, 1e-9), spread * 1e-6) - 1, 0)
    shrunk = {s: (b + strength * mean) / (n + strength) for s, (n, b) in hosts.items()}
    kept = [(d, t) for k, (d, t, s) in enumerate(rows) if not figures[k][5] and shrunk[s] <= 0.5 and (shrunk[s] <= 0.02 or not soft[k])]

    # Two groups may have the same least id, where rows share it.
    prints = [int(p, 16) for _, p, _ in simhash.brute(kept)]
    group = list(range(len(kept)))
    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 2 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    chosen = {}
    for (d, t), p, g in zip(kept, prints, group):
        key = (d is None, d or 0, p - (1 << 64) if p >> 63 else p)
        if g not in chosen or key < chosen[g][0]:
            chosen[g] = (key, d, t)
    kept = [(d, t) for _, d, t in chosen.values()]

    least = {}
    for d, t in kept:
        w = (t or "").encode().split()
        for i in range(len(w) - 49):
            if d is not None:
                key = tuple(w[i : i + 50])
                least[key] = min(d, least.get(key, d))
    short = []
    for d, t in kept:
        places = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        raw, w = (t or "").encode(), (t or "").encode().split()
        gone = {p for i in range(len(w) - 49) if d is not None and least[tuple(w[i : i + 50])] < d for p in range(i, i + 50)}
        out, at = b"", 0
        for i, (a, _) in enumerate(places):
            if i in gone and i - 1 not in gone:
                out += raw[at:a]
            if i in gone:
                at = places[i + 1][0] if i + 1 < len(places) else len(raw)
        short.append((d, (out + raw[at:]).decode() if gone else t))
    clean = [(d, t) for (d, t), r in zip(short, decontaminate.brute(short, bench)) if not r[5]]
    return sorted(((d, k // 2048, tuple(own_ids(t)[k : k + 2048])) for d, t in clean for k in range(0, max(len(own_ids(t)), 1), 2048)), key=str)


def found_run(spark, at):
    import numpy as np

    rows = corpus_pipeline.run(spark, at).select("doc_id", "piece", "token_ids").collect()
    return sorted(((r["doc_id"], r["piece"], tuple(np.frombuffer(bytes(r["token_ids"]), "<u2").tolist())) for r in rows), key=str)


def test_run(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    want = brute_run(rows, bench)
    assert want and found_run(spark, data) == want


def test_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated rows, empty and blank texts, columns that clash; and empty tables."""
    rng = random.Random(11)
    some = lambda n: " ".join(f"w{rng.randrange(10**4)}" for _ in range(n))
    passage, item = some(70), some(30)
    rows = [(1, passage, "a"), (2, f"{some(60)} {passage}", "a"), (2, f"{some(60)} {passage}", "a"), (3, f"{some(80)} {item}", None), (4, some(90), None), (4, some(90), "b")]
    rows += [(None, some(100), "b"), (None, None, None), (5, None, "a"), (6, "", "a"), (7, " \n\t", None), (8, f"{some(55)}\u00e9\U0001f600 {passage}\n\n{some(5)} ", "c")]
    columns = "doc_id long, text string, lang string, source string, n_chars long, simhash string, n_words string, kept string, batch string, token_ids string, contaminated string"
    table = spark.createDataFrame([(d, t, None, s, None if t is None else len(t), *["mine"] * 6) for d, t, s in rows], columns)
    at = str(tmp_path / "odd")
    table.repartition(3).write.parquet(f"{at}/documents.parquet")
    bench = [(1, item), (None, "w1"), (3, None), (4, "")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, at))
        assert docs.columns == table.columns and docs.where("kept <> 'mine' or simhash <> 'mine'").isEmpty(), name
    assert found_run(spark, at) == brute_run(rows, [(a, b) for a, b in bench])
    none = str(tmp_path / "none")
    table.limit(0).write.parquet(f"{none}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{none}/benchmark.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    found = queries.queries()[name](spark, data)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(found.columns) == sorted(want.columns)
    order = sorted(found.columns)
    assert sorted(map(str, (tuple(r) for r in found.select(*order).collect()))) == sorted(map(str, want.select(*order).fetchall()))
