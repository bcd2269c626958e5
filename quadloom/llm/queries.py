"""Queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadloom.llm.wavelet import round_trip

    return round_trip(_table(spark, sf_dir, "documents"))


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadloom.llm.quality import measure

    return measure(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, ws[i:i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(ls) AS l FROM w),
judged AS (SELECT doc_id, length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) AS visible, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS nw,
  len(regexp_extract_all(l, '[^\p{L}\p{N}\p{M}\s]')) AS marks, regexp_matches(l, '[.!?\x{2026}:;\x22''\x{201D}\x{2019}\x{BB})\x{3002}]\s*$') AS closed,
  len(list_filter(string_split_regex(l, '\s+'), lambda x: regexp_full_match(x, '[|>/\x{BB}\x{B7}\x{2022}\x{2013}\x{2014}-]+'))) AS seps,
  regexp_matches(lower(l), '@BOILERPLATE@') AS boiler FROM line),
lost AS (SELECT doc_id, sum(visible) FILTER (WHERE NOT (marks * 100 > visible * 20 OR (nw < 4 AND NOT closed) OR (seps >= 3 AND seps * 5 >= nw) OR boiler)) AS left_chars FROM judged GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(left_chars, 0) AS left_chars
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (100 * (word_chars - left_chars) > 50 * word_chars) AS kept FROM m"""


def op3_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadloom.llm.langid import predict

    return predict(_table(spark, sf_dir, "documents"))


def op4_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadloom.llm.wordpiece import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"))


def op5_patience_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadloom.llm.linedup import remove_lines

    return remove_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadloom.llm.toxicity import predict

    return predict(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadloom.llm.simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadloom.llm.decontam import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadloom.llm.substring import digest, remove_repeats

    return digest(remove_repeats(_table(spark, sf_dir, "documents")))


#: Every 50-word window, its smallest document, and what is left of each text.
OP9_SQL = """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
wins AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS win FROM starts),
hit AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) < doc_id AS again FROM wins),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM hit WHERE again),
lists AS (SELECT doc_id, list(pos) AS poss, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN n IS NULL THEN ws ELSE list_filter(ws, lambda x, p: NOT list_contains(poss, p)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN lists USING (doc_id)"""


def op10_ordered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadloom.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_wavelet_shards, op2_line_quality, op3_language_bitmask, op4_wordpiece_counts, op5_patience_lines, op6_toxicity_gru, op7_simhash_bktree, op8_latent_decontamination, op9_repeated_windows, op10_ordered_packing)}


def oracle_sql() -> dict[str, str]:
    from quadloom.llm.quality import BOILERPLATE

    return {"op2_line_quality": OP2_SQL.replace("@BOILERPLATE@", BOILERPLATE), "op9_repeated_windows": OP9_SQL}
