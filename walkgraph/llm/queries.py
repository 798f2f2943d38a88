"""The queries of this subpackage: each applies an operator to its whole table; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkgraph.llm import chat, decontaminate, encoding, ordering, packing, quality, sharding, simhash, substrings, tokens, urls
from walkgraph.llm.common import fresh_path

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontaminate.judge(docs, benchmark, ["doc_id"]).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame(urls.labelled(), "url string, label int")
    return urls.judge(_table(spark, sf_dir, "pages"), table, carry=["page_id"])


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(_table(spark, sf_dir, "conversations"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup(_table(spark, sf_dir, "documents"), ["doc_id"], texts=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), ["doc_id"])
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), ids=encoding.public_ranks())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "soft_failed", "host_verdict")


def op9_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.materialise(_table(spark, sf_dir, "documents"), fresh_path(spark, "shards"), encoding.public_ranks())


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), ["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_decontaminate, op2_urls, op3_chat, op4_substrings, op5_tokens, op6_sharding, op7_packing, op8_quality, op9_ordering, op10_simhash)}


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
items AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
  FROM b, unnest(range(1, greatest(len(w) - 12, least(len(w), 1)) + 1)) AS u(i)),
places AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM d, (SELECT DISTINCT k FROM items), unnest(range(1, len(w) - k + 2)) AS u(i)),
found AS (SELECT doc_id, i, places.k, item_id FROM places JOIN items USING (s)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM found, unnest(range(i, i + k)) AS u(p) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(ids.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids.s, '')) AS items_sha256,
       coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (
  SELECT rid, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s FROM d, unnest(range(1, len(w) - 48)) AS u(i)),
least AS (SELECT s, min(doc_id) AS first FROM places GROUP BY s),
gone AS (
  SELECT DISTINCT rid, p FROM places JOIN least USING (s), unnest(range(i, i + 50)) AS u(p) WHERE first < doc_id),
lists AS (SELECT rid, list(p) AS ps FROM gone GROUP BY rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE
         [x[1] for x in list_zip(w, range(1, len(w) + 1)) if NOT list_contains(ps, x[2])] END, ' ')) AS kept_sha256
FROM d LEFT JOIN lists USING (rid)
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS s FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
twice AS (SELECT doc_id, s FROM places GROUP BY doc_id, s HAVING count(*) > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM places JOIN twice USING (doc_id, s), unnest(range(i, i + 3)) AS u(p) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len([x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')])
           - len(list_distinct([x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')])) AS n_dup_lines,
         len([x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')]) AS n_lines, coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN repeats USING (doc_id)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines AS soft_failed FROM f),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR soft_failed) AS bad FROM g GROUP BY source),
m AS (SELECT avg(bad / n) AS m, var_samp(bad / n) AS v, avg(1 / n) AS r FROM h),
s AS (
  SELECT m, CASE WHEN m * (1 - m) > 0 AND v IS NOT NULL
    THEN greatest(m * (1 - m) / greatest((v - m * (1 - m) * r) / greatest(1 - r, 1e-9), m * (1 - m) * 1e-6) - 1, 0) ELSE 0 END AS k FROM m),
v AS (SELECT source, CASE WHEN (bad + k * m) / (n + k) > 0.5 THEN 'reject' WHEN (bad + k * m) / (n + k) <= 0.02 THEN 'trust' ELSE 'strict' END AS host_verdict FROM h, s)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND (host_verdict = 'trust' OR (host_verdict = 'strict' AND NOT soft_failed)) AS kept, soft_failed, host_verdict
FROM g JOIN v ON g.source IS NOT DISTINCT FROM v.source
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op4_substrings": OP4_SQL, "op8_quality": OP8_SQL}
