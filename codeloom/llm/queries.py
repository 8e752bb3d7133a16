"""The operators over the driver's tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bpe, chat_format, decontam, license_scan, quality_classifier, quality_rules, sharding, simhash, token_store, url_filter
from codeloom.llm.common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.train(url_filter.weak_labels(pages)))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, rejected = chat_format.echo_pairs(table(spark, sf_dir, "conversations"))
    trained = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    pairs = chat_format.preferences(chosen, rejected)
    return pairs.select("pair_id", "n_prompt_turns", *[F.sha2(F.col(c), 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")], trained("chosen_spans").alias("chosen_trained"), trained("rejected_spans").alias("rejected_trained"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"), "best_license", "best_dice")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_store.shared_folder(spark)
    token_store.write(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), folder, end=2)
    return token_store.read(spark, folder)


def op10_byte_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shards(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


_WORD = r"[^\x20\x09-\x0D]+"
_OP1 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS once, count(*) FILTER (regexp_matches(line, '^[\x20\x09-\x0D]*[-*•]')) AS bullets FROM l WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM win) WHERE c > 1),
covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS at FROM again) GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word FROM d),
per AS (SELECT doc_id, CAST(sum(len(word)) AS BIGINT) AS chars, count(*) FILTER (regexp_matches(word, '[A-Z]') AND NOT regexp_matches(word, '[a-z]') AND strlen(word) > 1) AS caps, count(*) FILTER (regexp_matches(word, '[A-Za-z]|[^\x00-\x7F]')) AS lettered FROM words GROUP BY doc_id),
top AS (SELECT doc_id, max(c) AS c FROM (SELECT doc_id, word, count(*) AS c FROM words GROUP BY ALL) GROUP BY doc_id),
base AS (SELECT d.doc_id, len(w) AS n_words, coalesce(chars, 0) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n - once, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines, coalesce(bullets, 0) AS bullets, coalesce(caps, 0) AS caps, coalesce(lettered, 0) AS lettered, coalesce(top.c, 0) AS most
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN per USING (doc_id) LEFT JOIN top USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 10 * n_symbols <= n_words AND 2 * n_dup_lines <= n_lines AND 10 * caps <= 3 * n_words AND 10 * most <= 3 * n_words AND 10 * lettered >= 6 * n_words AND 10 * bullets <= 9 * n_lines AS kept
FROM base"""
_OP7 = """
WITH t AS (SELECT conv_id, regexp_replace(coalesce(role, 'unknown'), '[^\\p{L}\\p{N}_.-]', '_', 'g') AS role, role AS r, coalesce(text, '') AS text, row_number() OVER w AS pos, lag(text) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
last AS (SELECT conv_id, max(pos) FILTER (r = 'assistant') AS p FROM t GROUP BY conv_id),
said AS (SELECT t.conv_id, role, pos, text AS c, CASE WHEN pos = p THEN coalesce(before, '') ELSE text END AS r FROM t JOIN last USING (conv_id)),
sides AS (SELECT conv_id, role, pos, regexp_replace(c, '<(\\\\*)\\|', '<\\\\\\1|', 'g') AS c, regexp_replace(r, '<(\\\\*)\\|', '<\\\\\\1|', 'g') AS r FROM said),
cut AS (SELECT conv_id, coalesce(min(pos) FILTER (c <> r), max(pos) + 1) AS d FROM sides GROUP BY conv_id),
parts AS (SELECT conv_id, pos, d, role, '<|' || role || '|>' || chr(10) || c || '<|end|>' || chr(10) AS cr, '<|' || role || '|>' || chr(10) || r || '<|end|>' || chr(10) AS rr, length(c) + 7 AS cn, length(r) + 7 AS rn FROM sides JOIN cut USING (conv_id))
SELECT conv_id AS pair_id, d - 1 AS n_prompt_turns,
  sha256(coalesce(string_agg(cr, '' ORDER BY pos) FILTER (pos < d), '')) AS prompt_sha256,
  sha256(coalesce(string_agg(cr, '' ORDER BY pos) FILTER (pos >= d), '')) AS chosen_sha256,
  sha256(coalesce(string_agg(rr, '' ORDER BY pos) FILTER (pos >= d), '')) AS rejected_sha256,
  CAST(coalesce(sum(cn) FILTER (pos >= d AND role = 'assistant'), 0) AS BIGINT) AS chosen_trained,
  CAST(coalesce(sum(rn) FILTER (pos >= d AND role = 'assistant'), 0) AS BIGINT) AS rejected_trained
FROM parts GROUP BY conv_id, d"""


def oracle_sql() -> dict[str, str]:
    """Trained models, hashes, merges and differencing have no SQL; tests hold those to brute force."""
    return {"op1_quality_rules": _OP1, "op7_chat_preferences": _OP7}
