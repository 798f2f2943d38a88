"""Each operator against a brute-force version, and the odd cases of its input."""

import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from walkgraph.llm import chat, common, decontaminate, encoding, ordering, packing, quality, sharding, simhash, substrings, tokens, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, base=200):
    return [f"w{rng.randrange(base)}" for _ in range(n)]


def corpus(n=60):
    """Copies, near copies, shared passages, a hot source, odd texts, null and repeated ids."""
    rng = random.Random(5)
    passage = " ".join(words(rng, 60))
    out = []
    for i in range(n):
        t = words(rng, rng.choice([1, 3, 20, 80, 200]))
        if i % 5 == 0:
            t[len(t) // 2 : len(t) // 2] = passage.split()
        out.append((i, "\n".join(" ".join(t[k : k + 17]) for k in range(0, len(t), 17))))
    out += [(100 + i, out[3][1]) for i in range(6)] + [(120, out[5][1].replace("w1 ", "W1 ")), (121, out[5][1] + " more")]
    out += [(200, None), (201, ""), (202, " \n\t "), (203, "a\x00b"), (204, "Ünïcode — ₤ 😀 ſ"), (205, " ".join(words(rng, 5000, 40)))]
    out += [(None, out[0][1]), (None, None), (7, out[7][1]), (7, "another text of the same id"), (300, "x"), (300, "x")]
    return [(a, b, "en", f"s{i % 3}" if i % 7 else None, None if b is None else len(b)) for i, (a, b) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return common.checkpointed(spark.createDataFrame(corpus(), SCHEMA).repartition(5))


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def pairs():
    return [(a, b) for a, b, *_ in corpus()]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1


ITEMS = [(1, " ".join(f"w{i}" for i in range(40))), (2, "w1 W2"), (3, None), (4, "--"), (None, "w5 w6"), (5, "w7"), (5, "w9 w8")]


def test_decontaminate(spark, docs):
    passage = corpus()[5][1]
    items = [*ITEMS, (9, passage)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = sorted(decontaminate.brute(pairs(), items), key=str)
    assert rows(decontaminate.judge(docs, bench, ["doc_id"]), *names) == want
    assert any(r[5] for r in want) and not all(r[5] for r in want)
    clean = decontaminate.clean(docs.withColumn("n_hit", F.lit("mine")), bench)
    assert clean.columns == [*docs.columns, "n_hit"] and clean.count() == sum(not r[5] for r in want)
    assert decontaminate.judge(empty(spark), bench).count() == 0
    none = decontaminate.judge(docs, bench.limit(0), ["doc_id"])
    assert none.where("contaminated or n_hit > 0").count() == 0 and none.count() == len(want)


def test_decontaminate_in_blocks(spark, docs, monkeypatch):
    items = [*ITEMS, (9, corpus()[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(decontaminate.judge(docs, bench, ["doc_id"]), *names) == sorted(decontaminate.brute(pairs(), items), key=str)


# 2


URLS = [
    (1, "http://EXAMPLE.com/en/x"), (2, "https://www.example.com/en/?q"), (3, "http://a.net/es/1#t"), (4, "http://net"), (5, "http://net/es"),
    (6, None), (7, "no scheme"), (8, "http://notexample.com/en/"), (9, "ftp://b.org?x/y"), (10, "http://x.com"), (11, "http://blog.www.example.com/en/"),
    (12, "://"), (13, "http://h/p\nq"), (13, "http://h/p\nq"),
]


def url_brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for h, p, v in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, best


def test_urls(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string").withColumn("rule", F.lit("mine"))
    out = urls.judge(pages, spark.createDataFrame(urls.labelled(), "url string, label int"))
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict", "score"]
    found = out.collect()
    assert len(found) == len(URLS)
    for r in found:
        host, path, best = url_brute(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best[0] if best else None)
        assert r["verdict"] == (best[1] if best else "block" if r["score"] > 0 else "allow")
    assert urls.judge(pages.limit(0), spark.createDataFrame([], "url string, label int")).count() == 0


def figures(rows_):
    """Precision and recall of (label, score) rows."""
    right = sum(y for y, z in rows_ if z > 0)
    return right / max(sum(z > 0 for _, z in rows_), 1), right / max(sum(y for y, _ in rows_), 1)


def test_url_model_on_held_out_words(spark):
    """Precision and recall over five folds of the labelled words."""
    words = [(w, 1) for w in urls.BLOCKED_WORDS] + [(w, 0) for w in urls.ALLOWED_WORDS]
    found = []
    for k in range(5):
        held = {w for i, (w, _) in enumerate(words) if i % 5 == k}
        inside = [(u, y) for u, y in urls.labelled() if not any(f".{w}." in u or f"/{w}." in u for w in held)]
        model = urls.train(spark.createDataFrame(inside, "url string, label int"))
        out = [(u, y) for u, y in urls.labelled() if (u, y) not in set(inside)]
        assert out
        test = spark.createDataFrame(out, "url string, label int").select("label", urls.host_of("url").alias("host"), urls.path_of("url").alias("path"))
        found += [tuple(r) for r in test.select("label", urls.score(model)).collect()]
    precision, recall = figures(found)
    assert precision >= 0.65 and recall >= 0.6, (precision, recall)  # 0.70 and 0.67: many plain words of the table hold unwanted n-grams


#: Unwanted hosts of the test tables; the labelled table has none of them.
UNWANTED = ("adult-x", "casino-win", "ads-track", "free-bets", "spam-farm", "cheap-pills")


def test_url_model_on_the_hosts_of_pages(spark, data):
    """No host of pages is in the labelled table; the model, without rules, finds the unwanted ones among them."""
    pages = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.1')}/pages.parquet")
    hosts = {r["h"] for r in pages.select(urls.host_of("url").alias("h")).distinct().collect()}
    assert not hosts & {urls_host for urls_host in (u.split("/")[2] for u, _ in urls.labelled())}
    assert not any(w in u for w in UNWANTED for u, _ in urls.labelled())
    out = urls.judge(pages, spark.createDataFrame(urls.labelled(), "url string, label int"), rules=[])
    rows_ = [(int(any(w in r["host"] for w in UNWANTED)), r["score"]) for r in out.select("host", "score").collect()]
    precision, recall = figures(rows_)
    assert precision >= 0.9 and recall >= 0.6, (precision, recall)


def test_url_scores_by_hand(spark):
    """The score of each url as a sum of weights over n-grams cut here."""
    import xxhash

    names = [u for _, u in URLS] + ["https://x.org/" + "é😀a" * 50]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(names)], "page_id long, url string")
    table = spark.createDataFrame(urls.labelled(), "url string, label int")
    weights, constant = urls.train(table)
    weights = [float(f"{w:.9g}") for w in weights]
    for r in urls.judge(pages, table, rules=[]).collect():
        s, found = f"^{r['host']}|{r['path']}$", set()
        if r["host"] or r["path"]:
            for n in urls.SIZES:
                found |= {s[i : i + n] for i in range(max(len(s) - n + 1, 1))}
        buckets = {xxhash.xxh64_intdigest(g.encode(), 42) for g in found}
        total = constant + sum(weights[b] for b in {(h - (1 << 64) if h >> 63 else h) % urls.BUCKETS for h in buckets})
        assert abs(r["score"] - total) < 1e-6


def test_a_very_long_url(spark):
    """A url of a megabyte takes time in proportion to its length."""
    import time

    long = "https://x.example.org/" + "abcdefghij" * 100_000
    pages = spark.createDataFrame([(1, long), (2, "https://x.example.org/a")], "page_id long, url string")
    began = time.time()
    out = urls.judge(pages, spark.createDataFrame(urls.labelled(), "url string, label int")).collect()
    assert len(out) == 2 and time.time() - began < 120


# 3


def repair_cost(roles):
    """Least cost by trying everything, state by state."""
    best = {chat.BEGIN: 0}
    for role in roles:
        now = {}
        for before, c in best.items():
            for b, to, cost, _ in chat.moves(role if role in chat.ROLES else None):
                if b == before:
                    now[to] = min(now.get(to, 10**9), c + cost)
        best = now
    return min(c + chat.INSERT * len(chat.AFTER[s]) for s, c in best.items())


def least_cost(roles):
    """Least cost with nothing of the module but its prices: every relabelling and every merge, then the shortest legal conversation that the turns are a part of, in order."""
    best = 10**9
    for new in itertools.product("sua", repeat=len(roles)):
        relabel = sum(chat.RELABEL for a, b in zip(roles, new) if (a or "?")[0] != b or a not in ("system", "user", "assistant"))
        for merges in itertools.product((False, True), repeat=len(roles) - 1):
            if any(m and new[i] != new[i + 1] for i, m in enumerate(merges)):
                continue
            turns = [new[0], *(b for b, m in zip(new[1:], merges) if not m)]
            for first in ("", "s"):
                for pairs_ in range(1, len(turns) + 2):
                    target = iter(first + "ua" * pairs_)
                    if all(t in target for t in turns):
                        best = min(best, relabel + chat.MERGE * sum(merges) + chat.INSERT * (len(first) + 2 * pairs_ - len(turns)))
    return best


def test_chat_costs_of_all_short_conversations(spark):
    every = [c for n in (1, 2, 3, 4) for c in itertools.product(("system", "user", "assistant", None), repeat=n)]
    rows_ = [(i, t, role, "x") for i, c in enumerate(every) for t, role in enumerate(c)]
    clash = "conv_id long, turn long, role string, text string"
    table = spark.createDataFrame(rows_, clash)
    for name in ("new_role", "cost", "pid", "conv", "tie", "rendered"):
        table = table.withColumn(name, F.lit("mine"))
    out = chat.repair(table)
    assert out.columns == ["conv_id", "turn", "role", "new_role", "action", "inserted", "appended", "cost", "rendered"]
    cost = {r["conv_id"]: r["c"] for r in out.groupBy("conv_id").agg(F.sum("cost").alias("c")).collect()}
    assert cost == {i: least_cost(c) for i, c in enumerate(every)}


def legal(text):
    roles = [x.split("\n")[0] for x in text.split(chat.OPEN)[1:]]
    if roles and roles[0] == "system":
        roles = roles[1:]
    return len(roles) % 2 == 0 and len(roles) > 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles))


@pytest.mark.parametrize("partitions", ["1", "4", "13"])
def test_chat(spark, partitions):
    rng = random.Random(3)
    rows_ = []
    for c in [None, *range(12)]:
        for t in range(rng.choice([1, 2, 5, 8]) if c != 5 else 400):
            rows_.append((c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), rng.choice(["hi", None, "", "text"])))
    rows_ += [(3, 0, "user", "hi")] * 3
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = chat.repair(spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(found) == len(rows_)
    by = {}
    for r in found:
        by.setdefault(r["conv_id"], []).append(r)
    for c, own in by.items():
        order = sorted((r for r in rows_ if r[0] == c), key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        assert [(r["turn"], r["role"]) for r in own] == [(r[1], r[2]) for r in order]
        assert sum(r["cost"] for r in own) == repair_cost([r[2] for r in order])
        text = "".join(r["rendered"] for r in own)
        assert legal(text) and text.count(chat.OPEN) == text.count(chat.CLOSE) and text.endswith(chat.CLOSE)


def test_chat_empty(spark):
    assert chat.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_is_the_same_for_any_dealing(spark):
    rng = random.Random(8)
    table = spark.createDataFrame([(1, t, rng.choice(chat.ROLES), "x") for t in range(300)], "conv_id long, turn long, role string, text string")
    outs = []
    for n in ("1", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        outs.append([tuple(r) for r in chat.repair(table).orderBy("turn").collect()])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert outs[0] == outs[1]


# 4


@pytest.mark.parametrize("window", [50, 5])
def test_substrings(spark, docs, window):
    out = substrings.dedup(docs, window=window)
    want = sorted(substrings.brute(pairs(), window), key=str)
    assert rows(out, "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert any(r[2] for r in want)


def test_shortened(spark, docs):
    out = substrings.shortened(docs.withColumn("n_words", F.lit("mine")))
    assert out.columns == [*docs.columns, "n_words"] and out.count() == docs.count()
    want = {r[3] for r in substrings.brute(pairs())}
    import hashlib

    for r in out.collect():
        assert hashlib.sha256(b" ".join((r["text"] or "").encode().split())).hexdigest() in want
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    assert substrings.dedup(empty(spark)).count() == 0


# 5


def tokenizer_file():
    P = pytest.importorskip("public_tokenizers")
    return P.path("word_bpe_49k.json")


def test_tokens(spark, docs):
    from tokenizers import Tokenizer

    file = tokenizer_file()
    t = Tokenizer.from_file(file)
    more = [(1000 + i, x) for i, x in enumerate(["Hello <|endoftext|> x", "don't CAN'T  I'm", "ΑΣ Σ", "\x1c a\x1fb", "a\xa0b\x85c", "İı ŉ ſ", "“q”—d…", "é é", "日本 語", "a1２³½", "\x01a\x7f"])]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = sorted(((d, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x in [*pairs(), *more]), key=str)
    out = tokens.count_tokens(table, file, limit=100)
    assert rows(out, "doc_id", "n_bytes", "n_tokens") == want
    assert out.where("over_limit <> (n_tokens > 100)").count() == 0
    assert tokens.count_tokens(empty(spark), file).count() == 0


def test_every_safe_character(spark):
    from tokenizers import Tokenizer

    with open(tokenizer_file(), encoding="utf-8") as f:
        content = f.read()
    t, counter = Tokenizer.from_str(content), tokens.Counter(content, tokens.whole_tokens(content))
    safe = [chr(i) for i in range(0x2100) if not tokens.UNSAFE.search(chr(i))]
    texts = [s for c in safe for s in (c, f"a{c}b", c + c, f"a {c}", f"{c}'s")]
    assert [counter.count(s) for s in texts] == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


# 6 and 9


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutation(n):
    import numpy as np

    out = common.permuted(np.arange(n), n, 9)
    assert sorted(out.tolist()) == list(range(n))
    assert n < 17 or out.tolist() != common.permuted(np.arange(n), n, 10).tolist()


def test_sharding(spark, docs):
    out = sharding.shard(docs.withColumn("slot", F.lit("mine"))).collect()
    assert len(out) == len(corpus())
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in out if r["doc_id"] is not None) == sorted(
        (a, len((b or "").encode()) + 1, zlib.crc32((b or "").encode())) for a, b in pairs() if a is not None)
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and set(by) == set(range(16))
    again = {(r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard(docs.repartition(2)).collect() if r["doc_id"] not in (300,)}
    assert again == {(r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in out if r["doc_id"] not in (300,)}
    assert sharding.shard(empty(spark)).count() == 0
    order = sorted(((a is not None, a or 0, len((b or "").encode()) + 1) for a, b in pairs()))
    assert sharding.locate(len(order) - 1, len(order)) == next((r["shard"], r["slot"]) for r in out if r["doc_id"] == 300 and (r["shard"], r["slot"]) == sharding.locate(len(order) - 1, len(order)))


def ranks():
    P = pytest.importorskip("public_tokenizers")
    return encoding.Ranks(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def own_ids(text):
    """By the library alone."""
    import base64

    import public_tokenizers as P
    import tiktoken

    if not hasattr(own_ids, "found"):
        with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own_ids.found = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})
    return own_ids.found.encode_ordinary(text or "")


def test_ids_are_the_library_s():
    import pyarrow as pa

    rng = random.Random(4)
    marks = [" ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\u00a0", "\u3000", "a", "'s", "'", "don't", "12", "3.5", "é", "日本", "😀", "_-", "<|endoftext|>", "\x00", "word", "Word,"]
    texts = [None, "", " ", "  ", " a", "a ", "\n a", "a \n b", "a \n\n b"] + ["".join(rng.choices(marks, k=rng.randint(1, 30))) for _ in range(4000)]
    found = ranks().encode(pa.array(texts))
    assert [list(map(int, __import__("numpy").frombuffer(x, "<u2"))) for x in found] == [own_ids(t) for t in texts]


def test_ordering_is_read_with_seeks(spark, docs, tmp_path):
    """Every piece by a seek to its offset in a plain file; the sequences are those of the stream made here, at the permutation's slots."""
    import json

    import numpy as np

    length, per_shard, path = 16, 10, tmp_path / "shards"
    out = ordering.materialise(docs, str(path), ranks(), length=length, per_shard=per_shard).collect()
    held = json.loads((path / "manifest.json").read_text())
    n = held["total"]
    files = sorted(p.name for p in path.iterdir() if p.name.endswith(".bin"))
    assert files == [ordering.shard_name(k) for k in range(-(-n // per_shard))]
    assert not [p for p in path.iterdir() if p.name.startswith(".shard")]
    assert sum((path / f).stat().st_size for f in files) == n * 2 * length
    texts, size = {}, 0
    for r in out:
        with open(path / ordering.shard_name(r["slot"] // per_shard), "rb") as f:
            f.seek(r["offset"])
            data = f.read(2 * r["n_tokens"])
        assert r["shard"] == r["slot"] // per_shard and r["offset"] // (2 * length) == r["slot"] % per_shard and zlib.crc32(data) == r["crc32"]
        texts.setdefault(r["doc_id"], []).append((r["part"], np.frombuffer(data, "<u2").tolist()))
        size += r["n_tokens"]
    want = {}
    for a, b in pairs():
        want.setdefault(a, []).append([*own_ids(b), 50256])
    assert size == sum(len(x) for v in want.values() for x in v) and n == -(-size // length)
    for a, lists in want.items():
        if len(lists) == 1:
            assert [x for _, ids in sorted(texts[a]) for x in ids] == lists[0]
    # The order of id is that of the stream but for rows that share an id.
    at, whole = 0, [x.tolist() for x in ordering.resume(str(path))]
    assert len(whole) == n
    for a in sorted(want, key=lambda a: (a is not None, a or 0)):
        if a not in (None, 7):
            for k, x in enumerate(want[a][0]):
                slot = int(common.permuted(np.array([(at + k) // length]), n, ordering.KEY)[0])
                assert whole[slot][(at + k) % length] == x
        at += sum(map(len, want[a]))
    last = whole[int(common.permuted(np.array([n - 1]), n, ordering.KEY)[0])]
    assert last[len(last) - (-size % length) :] == [65535] * (-size % length)
    assert [x.tolist() for x in ordering.resume(str(path), 25)] == whole[25:]


def test_ordering_does_not_hang_on_how_kept_ids_are_read(spark, tmp_path):
    """The same shards where each range of kept ids is read in many small splits; the session's settings are as before."""
    clean, most = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.files.maxPartitionBytes"
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 40)) for i in range(3000)], "doc_id long, text string").repartition(6)
    before = spark.conf.get(most), spark.conf.get(clean)
    ordering.materialise(docs, str(tmp_path / "a"), ranks(), length=16, per_shard=500)
    spark.conf.set(most, "2048")
    try:
        ordering.materialise(docs.repartition(3), str(tmp_path / "b"), ranks(), length=16, per_shard=500)
    finally:
        spark.conf.set(most, before[0])
    assert (spark.conf.get(most), spark.conf.get(clean)) == before
    shards = [{p.name: p.read_bytes() for p in (tmp_path / x).iterdir() if p.name.endswith(".bin")} for x in "ab"]
    assert len(shards[0]) > 3 and shards[0] == shards[1]


def test_ordering_of_nothing_and_of_equal_rows(spark, tmp_path):
    none = ordering.materialise(empty(spark), str(tmp_path / "none"), ranks())
    assert none.count() == 0 and list(ordering.resume(str(tmp_path / "none"))) == []
    same = spark.createDataFrame([(None, "", "mine")] * 50 + [(1, "a b", "mine")] * 50, "doc_id long, text string, slot string")
    out = ordering.materialise(same, str(tmp_path / "same"), ranks(), length=4, per_shard=7).collect()
    assert sorted(r["slot"] for r in out if r["offset"] // 2 % 4 == 0) == list(range(50)) and sum(r["n_tokens"] for r in out) == 200


# 7


def test_bounds_are_optimal():
    from itertools import combinations

    rng = random.Random(2)
    for _ in range(30):
        lengths = rng.sample(range(60), rng.randint(1, 8))
        h = {x: rng.randint(1, 9) for x in lengths}
        k = rng.randint(1, 4)

        def padding(tops):
            return sum((min(t for t in tops if t >= x) - x) * n for x, n in h.items())

        every = [(*c, max(h)) for m in range(k) for c in combinations(sorted(h)[:-1], m)]
        found = packing.bounds(h, k)
        assert len(found) <= k and padding(found) == min(map(padding, every))
    assert packing.bounds({}) == []


def test_packing(spark, docs):
    out = packing.pack(docs.withColumn("batch", F.lit("mine")), max_length=64, buckets=4, budget=256)
    found = out.collect()
    by_doc, by_batch = {}, {}
    for r in found:
        assert 0 <= r["length"] <= r["bucket_length"] <= 64 and r["start"] == r["piece"] * 64
        by_doc.setdefault(r["doc_id"], 0)
        by_doc[r["doc_id"]] += r["length"]
        by_batch.setdefault((r["bucket"], r["batch"]), []).append(r)
    want = {}
    for a, b in pairs():
        want[a] = want.get(a, 0) + len((b or "").encode().split())
    assert by_doc == want
    last = {b: max(k for c, k in by_batch if c == b) for b, _ in by_batch}
    for (bucket, batch), own in by_batch.items():
        top = max(own[0]["bucket_length"], 1)
        assert sorted(r["slot"] for r in own) == list(range(len(own))) and len(own) * top <= 256
        assert batch == last[bucket] or len(own) == 256 // top
    assert packing.pack(empty(spark)).count() == 0
    assert packing.pack(docs, length="n_chars").agg(F.sum("length")).first()[0] == sum(x[4] or 0 for x in corpus())


def test_packing_of_ids(spark, docs):
    """Each document's sequences hold its ids, whole and in order, and no batch is over the budget."""
    import numpy as np

    found = packing.pack(docs.withColumn("token_ids", F.lit("mine")), ids=ranks(), max_length=32, buckets=3, budget=128).collect()
    by_doc, by_batch = {}, {}
    for r in found:
        ids = np.frombuffer(bytes(r["token_ids"]), "<u2").tolist()
        assert len(ids) == r["length"] <= r["bucket_length"] and r["start"] == 32 * r["piece"]
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], ids))
        by_batch.setdefault((r["bucket"], r["batch"]), []).append(r)
    want = {}
    for a, b in pairs():
        ids = own_ids(b)
        want.setdefault(a, []).extend((k // 32, ids[k : k + 32]) for k in range(0, max(len(ids), 1), 32))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    assert all(len(own) * max(own[0]["bucket_length"], 1) <= 128 and sorted(r["slot"] for r in own) == list(range(len(own))) for own in by_batch.values())
    assert packing.pack(empty(spark), ids=ranks()).count() == 0


# 8


def quality_brute(t):
    t = t or ""
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    hit = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_quality(spark, docs):
    extra = [(400 + i, t) for i, t in enumerate(["a b c a b c a b c", "a a a a a", "x\n\nx\n x\nx", "# * $ a|b <c>", " ".join("abcd") * 40, "w " * 49, "w " * 51])]
    table = docs.unionByName(spark.createDataFrame([(a, b, "en", "s9", 0) for a, b in extra], SCHEMA)).withColumn("kept", F.lit("mine"))
    out = quality.judge(table)
    want = sorted(((a, *quality_brute(b)) for a, b in [*pairs(), *extra]), key=str)
    assert rows(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert out.where("kept and base_failed").count() == 0 and out.where("kept").count() > 0
    assert quality.judge(empty(spark)).count() == 0
    good = quality.good(docs.withColumn("n_words", F.lit("mine")))
    assert good.columns == [*docs.columns, "n_words"]


def test_hosts_shrink(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "bad"
    noisy = good + " #" * 20
    table = [(i, bad if i < 400 else good, "rotten") for i in range(404)] + [(500 + i, good, f"h{i % 20}") for i in range(400)]
    table += [(1000, bad, "tiny"), (1002, good, "tiny"), (1001, good, None)]
    table += [(2000 + i, noisy if i < 3 else good, "fine") for i in range(300)] + [(3000 + i, noisy if i < 30 else good, "mixed") for i in range(100)]
    docs = spark.createDataFrame([(a, t, "en", s, 0) for a, t, s in table], SCHEMA)
    hosts = {r["host"]: r for r in quality.host_rates(quality.measured(docs)).collect()}
    assert {h: hosts[h]["host_verdict"] for h in ("rotten", "tiny", "fine", "mixed")} == {"rotten": "reject", "tiny": "strict", "fine": "trust", "mixed": "strict"}
    assert hosts["tiny"]["shrunk_rate"] < hosts["tiny"]["rate"]
    # By hand: the prior's mean and strength from the moments of the rates.
    rates = [r["n_failed"] / r["n_docs"] for r in hosts.values()]
    mean = sum(rates) / len(rates)
    spread, inverse = mean * (1 - mean), sum(1 / r["n_docs"] for r in hosts.values()) / len(rates)
    variance = sum((x - mean) ** 2 for x in rates) / (len(rates) - 1)
    strength = max(spread / max((variance - spread * inverse) / (1 - inverse), spread * 1e-6) - 1, 0)
    for r in hosts.values():
        assert abs(r["shrunk_rate"] - (r["n_failed"] + strength * mean) / (r["n_docs"] + strength)) < 1e-9
    kept = {r["doc_id"] for r in quality.good(docs).collect()}
    assert kept == {500 + i for i in range(400)} | {1001, 1002} | {2000 + i for i in range(300)} | {3000 + i for i in range(30, 100)}


def test_host_verdicts_change_rows_of_the_test_tables(spark, data):
    out = quality.judge(spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet"), ["doc_id"])
    assert out.where("not base_failed and not kept").count() > 0


# 10


@pytest.mark.parametrize("small", [32, 1])
def test_simhash(spark, docs, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    want = sorted(simhash.brute(pairs()), key=str)
    out = simhash.near_duplicates(docs.withColumn("component_id", F.lit("mine")))
    assert rows(out, "doc_id", "fingerprint", "component_id") == want
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.one_of_each(empty(spark)).count() == 0


def test_masks_cover_every_pair_of_bits():
    masks = simhash.masks()
    assert all(any(not (m >> i & 1) and not (m >> j & 1) for m in masks) for i in range(64) for j in range(64))


@pytest.mark.parametrize("small", [32, 2])
def test_links_join_what_is_near(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(1)
    prints = {rng.getrandbits(64) for _ in range(50)}
    for base in list(prints)[:5]:
        x = base
        for _ in range(40):
            x ^= (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            prints.add(x)
        prints |= {base ^ (1 << i) for i in range(0, 64, 3)}
    values = sorted(prints)
    table = common.checkpointed(spark.createDataFrame([(simhash.signed(x),) for x in values], "simhash long"))
    root = {r["node"]: r["root"] for r in simhash.components(simhash.links(table)).collect()}
    own = {v: v for v in values}

    def top(x):
        while own[x] != x:
            x = own[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                own[top(a)] = top(b)
    for a in values:
        for b in values[:20]:
            same = root.get(simhash.signed(a), simhash.signed(a)) == root.get(simhash.signed(b), simhash.signed(b))
            assert same == (top(a) == top(b))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    root = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert root == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


# Very long texts, beyond what a kernel works on at once


@pytest.fixture(scope="module")
def long(spark):
    rng = random.Random(6)
    text = " ".join(f"{rng.randrange(10**18):018d}" for _ in range(120_000)) + " ümläut"
    assert len(text) > common.CHUNK_BYTES
    rows_ = [(1, text), (2, "a short one"), (3, "x " + text[:1000]), (4, text)]
    table = spark.createDataFrame([(a, b, "en", "s", len(b)) for a, b in rows_], SCHEMA)
    return rows_, common.checkpointed(table)


def test_long_texts(spark, long, tmp_path):
    from tokenizers import Tokenizer

    rows_, table = long
    items = [(1, " ".join(rows_[0][1].split()[-20:])), (2, "a short")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows(decontaminate.judge(table, bench, ["doc_id"]), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(decontaminate.brute(rows_, items))
    t = Tokenizer.from_file(tokenizer_file())
    assert rows(tokens.count_tokens(table, tokenizer_file()), "doc_id", "n_tokens") == [(a, len(t.encode(b, add_special_tokens=False).ids)) for a, b in rows_]
    assert rows(sharding.shard(table), "doc_id", "size", "text_crc32") == [(a, len(b.encode()) + 1, zlib.crc32(b.encode())) for a, b in rows_]
    figures_ = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows(quality.judge(table), "doc_id", *figures_) == [(a, *quality_brute(b)) for a, b in rows_]
    found = rows(simhash.near_duplicates(table), "doc_id", "fingerprint", "component_id")
    assert [f for _, f, _ in found[1:3]] == [f for _, f, _ in simhash.brute(rows_[1:3])] and found[0][1] == found[3][1] and found[3][2] == 1
    import numpy as np

    out = packing.pack(table, ids=ranks()).orderBy("doc_id", "piece").collect()
    for a, b in rows_[:3]:
        assert [x for r in out if r["doc_id"] == a for x in np.frombuffer(bytes(r["token_ids"]), "<u2").tolist()] == own_ids(b)
    ordering.materialise(table, str(tmp_path / "long"), ranks())
    stream = [x for a, b in rows_ for x in [*own_ids(b), 50256]]
    whole = list(ordering.resume(str(tmp_path / "long")))
    places = common.permuted(np.arange(len(whole)), len(whole), ordering.KEY)
    assert np.concatenate([whole[p] for p in places])[: len(stream)].tolist() == stream


def test_a_long_conversation(spark):
    text = "y" * (common.CHUNK_BYTES + 5)
    out = chat.repair(spark.createDataFrame([(1, 0, "user", text), (1, 1, "user", "z")], "conv_id long, turn long, role string, text string")).orderBy("turn").collect()
    assert text in out[0]["rendered"] and sum(r["cost"] for r in out) == least_cost(["user", "user"])
