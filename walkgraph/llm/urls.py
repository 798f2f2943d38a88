"""URL filter, in DataFrame functions only: host rules first, then a logistic regression on hashed n-grams.

Host: what follows the first '://' up to '/', '?', '#' or the end, A-Z lower-cased. Path: what
follows the host up to '?', '#' or the end. A rule (host, path, verdict) fits a url whose host is
the rule's or a subdomain of it and whose path starts with the rule's; of the rules that fit, the
longest wins (host and path together, then host). Where no rule fits, the model decides: the
character n-grams of host and path, hashed to BUCKETS features, in a logistic regression trained
on a small table of labelled urls. At most MAX_LABELLED of its rows are used, those with the
least hashes: a bounded sample. Training is full-batch gradient descent, written as one
expression over one row that holds the labelled rows' features; the weights, BUCKETS numbers
whatever the data, become a constant of the scoring expression. No join, no shuffle: a hot host
costs nothing.

Defined cases: a null url or one without '://' has an empty host and path, no rule, and the
verdict of the model's constant term, as do all urls without an n-gram. A very long url is scored
whole, in time proportional to its length. Repeated urls get equal verdicts. No labelled rows: all weights are zero and the verdict is allow. A column of pages
named as a result is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walkgraph.llm.common import checkpointed, without

BUCKETS = 1 << 15
SIZES = (3, 4, 5)
MAX_LABELLED = 512
STEPS = 200
RATE = 2.0
DECAY = 0.0005

#: The production rules.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: The small labelled table: host words of unwanted sites, and plain ones, under varied paths.
BLOCKED_WORDS = (
    "royalcasino casinoroyale grandcasino casino-online vegas-casino bestcasino casinobonus winbig bigwin winnersclub slots-win jackpotwin "
    "sportbets bets24 livebets betsonline top-bets freebet free-spins freecash freemovies-hd "
    "adultcams adult-video adultdating adultfriend xxx-tube xxxvideos x-rated "
    "pillstore dietpills pills-online bluepills cheapmeds cheap-viagra cheaprolex cheapwatches "
    "adserver popads ads-click clickads ads-network adstracker tracker-ads trackpixel track-clicks "
    "spamlist spam-mail spammer linkspam linkfarm farm-links contentfarm clickfarm"
).split()
ALLOWED_WORDS = (
    "library museum weather college garden recipes history science therapy network theatre station nation thunder heather western ontario "
    "interior erosion notable restore stables readers another kitchen bicycle letters painting orchard harvest village mountain river "
    "teacher student hospital clinic bakery windows winter window betterhome alphabet tibet address roads reading trackfield trains "
    "pillow spillway farmhouse farmers cheapest-flights freedom freelance freeway adulteducation"
).split()
FORMS = [
    "https://www.{}.example.info/en/{}", "http://{}.example.edu/de/{}.html", "https://blog.{}.example.io/fr/{}?page=2", "https://m.{}.example.info/en/{}/",
    "http://{}.example.io/es/{}#top", "https://www.{}.example.edu/item/{}?ref=x",
]


def labelled() -> list[tuple[str, int]]:
    """(url, 1 to block) rows of the small table."""
    out = []
    for label, words in ((1, BLOCKED_WORDS), (0, ALLOWED_WORDS)):
        for k, word in enumerate(words):
            for j in range(3):
                out.append((FORMS[(k + j * 2 + label) % len(FORMS)].format(word, 137 * (j + 2) + 31 * k), label))
    return out


def host_of(url: str | Column) -> Column:
    u = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    host = F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str | Column) -> Column:
    u = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    return F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(rules: list[tuple[str, str, str]], host: str = "host", path: str = "path") -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((F.col(host) == h) | F.col(host).endswith(f".{h}")) & F.col(path).startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def features(host: str, path: str) -> Column:
    """Buckets of the n-grams of host and path, each once."""
    # An array of characters: one is found at once, where a place in a string is counted from its beginning.
    s = F.split(F.concat(F.lit("^"), F.col(host), F.lit("|"), F.col(path), F.lit("$")), "")

    def grams(chars: Column, n: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0)))
        gram = lambda i: F.concat(*[F.coalesce(F.get(chars, i + k), F.lit("")) for k in range(n)])
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(gram(i)), F.lit(BUCKETS)).cast("int"))

    empty = (F.col(host) == "") & (F.col(path) == "")
    # transform() over an array of one binds the characters, which would else be cut anew for each place.
    all_grams = F.transform(F.array(s), lambda chars: F.array_distinct(F.concat(*[grams(chars, n) for n in SIZES])))
    return F.when(empty, F.array().cast("array<int>")).otherwise(all_grams[0])


def train(table: DataFrame, url: str = "url", label: str = "label") -> tuple[list[float], float]:
    """Weights of the buckets, and the constant term.

    Works on the rows' Gram matrix: the weights are a sum of the rows' features, so a step
    needs one number for each labelled row only."""
    rows = table.where(F.col(url).isNotNull() & F.col(label).isNotNull()).select(F.col(url).alias("u"), (F.col(label) > 0).cast("double").alias("y")).distinct()
    rows = rows.orderBy(F.xxhash64("u"), "u", "y").limit(MAX_LABELLED).select(host_of("u").alias("h"), path_of("u").alias("p"), "y")
    rows = checkpointed(rows.select("y", features("h", "p").alias("f")))
    one = rows.select(F.struct("y", "f").alias("r")).agg(F.sort_array(F.collect_list("r")).alias("r"))
    gram = F.transform("r", lambda a: F.transform("r", lambda b: 1.0 + F.size(F.array_intersect(a["f"], b["f"]))))
    one = checkpointed(one.select("r", gram.alias("k")))  # else each step would make the matrix anew
    n = F.greatest(F.size("r"), F.lit(1))

    def step(alpha: Column, _: Column) -> Column:
        def move(a: Column, i: Column) -> Column:
            z = F.aggregate(F.zip_with(F.get("k", i), alpha, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
            return a * (1 - DECAY) - RATE / n * (1 / (1 + F.exp(-z)) - F.get("r", i)["y"])

        return F.transform(alpha, move)

    start = F.transform("r", lambda _: F.lit(0.0))
    alpha = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)
    held = checkpointed(one.select("r", alpha.alias("a"))).select(F.explode(F.arrays_zip("r", "a")).alias("x"))
    held = held.select(F.col("x.a").alias("a"), F.col("x.r.f").alias("f"))
    weights = held.select(F.explode("f").alias("j"), F.col("a").alias("w")).groupBy("j").agg(F.sum("w").alias("w"))
    out = [0.0] * BUCKETS
    for r in weights.collect():  # at most BUCKETS rows
        out[r["j"]] = r["w"]
    return out, held.agg(F.sum("a")).first()[0] or 0.0


def score(model: tuple[list[float], float], host: str = "host", path: str = "path") -> Column:
    """The model's log-odds that the url is to be blocked."""
    table = F.split(F.lit(",".join(f"{w:.9g}" for w in model[0])), ",").cast("array<double>")
    f = features(host, path)
    return F.aggregate(f, F.lit(float(model[1])), lambda t, j: t + F.get(table, j))


def probability(log_odds: float) -> float:
    return 1 / (1 + math.exp(-log_odds))


def judge(pages: DataFrame, table: DataFrame, rules: list[tuple[str, str, str]] = RULES, url: str = "url", carry: list[str] | None = None) -> DataFrame:
    """pages with host, path, rule, verdict and score (log-odds to block; null where a rule decides)."""
    model = train(table)
    added = ["host", "path", "rule", "verdict", "score"]
    kept = [c for c in (pages.columns if carry is None else carry) if c not in added]
    base = pages.select(*kept, host_of(url).alias("host"), path_of(url).alias("path"))
    base = base.withColumn("__rule", ruled(rules))
    base = base.withColumn("score", F.when(F.col("__rule").isNull(), score(model)))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("score") > 0, "block").otherwise("allow"))
    return without(base.withColumn("rule", F.col("__rule.rule")).withColumn("verdict", verdict), ["__rule"]).select(*kept, *added)
