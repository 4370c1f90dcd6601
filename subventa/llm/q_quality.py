"""Query op9: quality verdict of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from subventa.llm import quality
from subventa.llm.registry import query, table

SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
w AS (
  SELECT doc_id, body,
    regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
t AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
k AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri FROM t),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM k) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, body, ls, len(ws)::BIGINT AS n_words,
    length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(body) - length(regexp_replace(body, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(body, '[\p{L}\x20\x09-\x0D]+', '', 'g')) AS others,
    length(regexp_replace(body, '\P{Lu}+', '', 'g')) AS shouts,
    length(body) - length(replace(body, '!', '')) AS bangs
  FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR 100 * n_symbols > 6 * word_chars
    OR 100 * others > 40 * word_chars
    OR 100 * shouts > 50 * (word_chars - others)
    OR 100 * bangs > 25 * n_words
    OR word_chars > 20 * n_words OR word_chars < 2 * n_words
    OR 100 * n_dup_lines > 60 * len(ls)) AS kept
FROM b
"""


@query("op9_quality_rules", SQL)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
