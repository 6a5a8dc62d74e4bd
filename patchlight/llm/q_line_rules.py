"""op9: line-first cleaning of all documents."""

from pyspark.sql import DataFrame, SparkSession

from .line_rules import clean_lines


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return clean_lines(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines")


OP9_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS x FROM documents),
w AS (
  SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS words, string_split(x, chr(10)) AS lines FROM t),
grams AS (
  SELECT k, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] AS g
  FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS p FROM w WHERE len(words) >= 3)),
twice AS (
  SELECT k, p FROM (SELECT k, p, count(*) OVER (PARTITION BY k, g) AS n FROM grams) WHERE n > 1),
covered AS (
  SELECT k, count(DISTINCT p + d) AS n FROM twice, (VALUES (0), (1), (2)) AS o(d) GROUP BY k),
lines AS (
  SELECT k, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT k, unnest(lines) AS line FROM w)),
judged AS (
  SELECT *, n = 0 OR (
      (regexp_matches(line, '[.!?\x{2026}]["''\x{201D}\x{2019}\x{00BB})\]]*[\x20\x09-\x0D]*$') OR n >= 10)
      AND len(regexp_extract_all(line, '[!?]{2,}')) * 4 <= n
      AND len(regexp_extract_all(line, '[#*$%&|<>]')) * 4 <= n
      AND len(regexp_extract_all(line, '[|\x{00BB}\x{203A}\x{2022}\x{00B7}]')) * 4 <= n
      AND NOT regexp_matches(line, '(?i)(all rights reserved|licensed under|terms of (use|service)|privacy policy|cookie (policy|settings)|accept (all )?cookies|enable javascript|lorem ipsum|sign up for our newsletter|share on (facebook|twitter)|powered by|copyright (\(c\)|\x{00A9}|[0-9]{4}))')) AS ok
  FROM lines),
by_text AS (
  SELECT k, count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS dup,
         count(*) FILTER (WHERE NOT ok) AS failed, coalesce(sum(n) FILTER (WHERE ok), 0) AS stay
  FROM judged GROUP BY k),
counts AS (
  SELECT w.doc_id, len(w.words)::BIGINT AS n_words, length(array_to_string(w.words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(w.x, '[#*$%&|<>]'))::BIGINT AS n_symbols, b.dup::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, b.failed::BIGINT AS n_failed_lines, b.stay
  FROM w JOIN by_text b USING (k) LEFT JOIN covered c USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_failed_lines,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND stay * 100 >= n_words * 70 AS kept
FROM counts
"""
