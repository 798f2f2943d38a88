"""Host-level quality rules, in DataFrame functions only.

Each document gets base figures and is judged by four rules. Two are hard, and a document that
breaks one has failed the base rule: fewer than MIN_WORDS words, or more than half of the words in
windows of 3 words that the document has twice or more. Two are soft: more than a symbol in ten
words, or more than half of the lines equal to earlier ones.

Documents that break any rule are added up by host (the `source` column). A beta prior, fitted to
all hosts' rates by moments, shrinks each host's rate towards the others', the more the fewer
documents it has. The shrunk rate gives the host's verdict:

* reject, over MAX_RATE: most of what the host has is bad, and all its documents go;
* trust, at most TRUSTED_RATE: soft rules are taken for false alarms and forgiven;
* strict, in between: its documents that break a soft rule go.

A document is kept if it passes the base rule and its host's verdict lets it.

Words lie between ASCII white space. Hot hosts cost nothing: failures are added up before the
shuffle, and hosts' verdicts come back as a broadcast while hosts are at most BROADCAST_HOSTS,
else by a join that adaptive execution may split.

Defined cases: a null or empty text has no words and fails. Documents without a host are one
host, null, which is judged like the others. No documents: no rows. A single host has no prior
but its own rate. Repeated rows count each time. A column of documents named as a result is
replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkgraph.llm.common import checkpointed, sheltered, without, written

MIN_WORDS = 50
MAX_RATE = 0.5
TRUSTED_RATE = 0.02
BROADCAST_HOSTS = 100_000
WORD = r"[^\x20\x09-\x0D]+"
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "soft_failed"]
VERDICTS = ["host_verdict", "kept"]


def measured(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """documents with FIGURES; without the columns that are not in carry (all by default)."""
    kept = [c for c in (docs.columns if carry is None else carry) if c not in FIGURES]
    whole = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(*kept, whole.alias("__t"))
    lines = F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(WORD))
    step1 = base.select(
        *kept,
        F.regexp_extract_all("__t", F.lit(WORD), F.lit(0)).alias("__w"),
        (F.length("__t") - F.regexp_count("__t", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("__l"),
    )
    window = F.transform(
        F.sequence(F.lit(0), F.size("__w") - 3),
        lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)),
    )
    step2 = step1.select(
        *kept, "word_chars", "n_symbols",
        F.size("__w").cast("long").alias("n_words"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size("__l").cast("long").alias("__lines"),
        F.when(F.size("__w") < 3, F.array().cast("array<bigint>")).otherwise(window).alias("__h"),
    )
    # Only texts with a repeated window need their windows in order.
    again = F.size(F.array_distinct("__h")) < F.size("__h")
    placed = F.array_sort(F.transform("__h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    step3 = step2.withColumn("__o", F.when(again, placed)).drop("__h")
    last = F.size("__o") - 1
    twice = F.filter("__o", lambda s, k: ((k > 0) & (F.get("__o", F.greatest(k - 1, F.lit(0)))["x"] == s["x"])) | ((k < last) & (F.get("__o", k + 1)["x"] == s["x"])))
    step4 = step3.withColumn("__p", F.array_sort(F.transform(twice, lambda s: s["i"]))).drop("__o")
    covered = F.aggregate(
        "__p",
        F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(i - a["at"], F.lit(3))).alias("n")),
        lambda a: a["n"],
    )
    out = step4.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__p")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    soft = (10 * F.col("n_symbols") > F.col("n_words")) | (2 * F.col("n_dup_lines") > F.col("__lines"))
    return out.withColumn("base_failed", failed).withColumn("soft_failed", soft).select(*kept, *FIGURES)


def host_rates(marked: DataFrame, host: str = "source") -> DataFrame:
    """(host, n_docs, n_failed, rate, shrunk_rate, host_verdict) from documents with base_failed and soft_failed."""
    by = marked.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum((F.col("base_failed") | F.col("soft_failed")).cast("long")).alias("n_failed"))
    by = checkpointed(by)
    rate = F.col("n_failed") / F.col("n_docs")
    # Moments over hosts; a host's own noise, p (1 - p) / n on average, isn't the hosts' variance.
    m = by.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"), F.avg(1 / F.col("n_docs")).alias("r")).first()
    mean, strength = m["m"] or 0.0, 0.0
    spread = mean * (1 - mean)
    if spread > 0 and m["v"] is not None:
        between = max((m["v"] - spread * m["r"]) / max(1 - m["r"], 1e-9), spread * 1e-6)
        strength = max(spread / between - 1, 0.0)
    shrunk = (F.col("n_failed") + strength * mean) / (F.col("n_docs") + strength)
    verdict = F.when(F.col("shrunk_rate") > MAX_RATE, "reject").when(F.col("shrunk_rate") <= TRUSTED_RATE, "trust").otherwise("strict")
    return by.withColumn("rate", rate).withColumn("shrunk_rate", shrunk).withColumn("host_verdict", verdict)


def with_verdict(marked: DataFrame, hosts: DataFrame, host: str = "source") -> DataFrame:
    """Documents with base_failed and soft_failed get `host_verdict` and `kept`."""
    side = hosts.select(F.col("host").alias("__host"), "host_verdict")  # a checkpoint, a row for each host
    side = F.broadcast(side) if side.count() <= BROADCAST_HOSTS else side
    out = marked.join(side, F.col(host).eqNullSafe(F.col("__host")), "left").drop("__host")
    lets = (F.col("host_verdict") == "trust") | ((F.col("host_verdict") == "strict") & ~F.col("soft_failed"))
    return out.withColumn("kept", ~F.col("base_failed") & lets)


def judge(docs: DataFrame, carry: list[str] | None = None, host: str = "source", text: str = "text") -> DataFrame:
    """documents with FIGURES, host_verdict and kept. The figures are made once and kept without the text, unless it is carried."""
    marked = written(measured(without(docs, VERDICTS), text, carry if carry is None or host in carry else [*carry, host]))
    return with_verdict(marked, host_rates(marked, host), host)


def good(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The documents that are kept, as they were."""
    inside, back = sheltered(docs, [*FIGURES, *VERDICTS])
    return back(judge(inside, None, host, text).where("kept"))
