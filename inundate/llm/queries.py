"""The operators' queries over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, fingerprints, langid, likelihood, packing, quality, secrets, segments, simhash, suffixes
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(conversations.unionByName(planted)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op8_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return segments.digest(segments.encode(table(spark, sf_dir, "documents"), model), model)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digest(fingerprints.compare_with_edits(table(spark, sf_dir, "documents")))


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihood.score(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_quality_rules, op2_chat_format, op3_language_id, op4_simhash, op5_secret_scan, op6_packing,
        op7_suffix_dedup, op8_segmentations, op9_fingerprints, op10_pseudo_likelihood,
    )
    return {f.__name__: f for f in every}


CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, regexp_replace(text, '(\\*)(### |</turn>)', '\\\1\2', 'g') AS body,
    replace(replace(role, '\', '\\'), chr(10), '\n') AS named FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(named) + length(body) + 14) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

REPEATS_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, b[i:i + 99] AS s FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS i FROM d WHERE octet_length(b) >= 100)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM f WHERE k > 1),
n AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM g),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM n GROUP BY doc_id, s),
cuts AS (SELECT doc_id, a, z FROM spans UNION ALL SELECT doc_id, 0, 1 FROM d),
kept AS (SELECT c.doc_id, c.z AS a, coalesce(lead(c.a) OVER (PARTITION BY c.doc_id ORDER BY c.a), octet_length(d.b) + 1) AS z, b FROM cuts c JOIN d USING (doc_id)),
rest AS (SELECT doc_id, sha256(unhex(coalesce(string_agg(CASE WHEN z > a THEN hex(b[a:z - 1]) ELSE '' END, '' ORDER BY a), ''))) AS kept_sha256 FROM kept GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(d.b) AS BIGINT) AS n_bytes, CAST(coalesce(t.r, 0) AS BIGINT) AS n_removed, CAST(coalesce(t.c, 0) AS BIGINT) AS n_spans, kept_sha256
FROM d JOIN rest USING (doc_id) LEFT JOIN (SELECT doc_id, sum(z - a) AS r, count(*) AS c FROM spans GROUP BY 1) t USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": CHAT_SQL, "op7_suffix_dedup": REPEATS_SQL}
