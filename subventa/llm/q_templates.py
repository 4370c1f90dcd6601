"""Query op1: documents without lines of recurring templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from subventa.llm.registry import query, table
from subventa.llm.templates import without_recurring

SQL = r"""
WITH d AS (SELECT DISTINCT text AS row FROM documents WHERE text IS NOT NULL),
l AS (SELECT row, unnest(string_split(row, chr(10))) AS line, unnest(range(len(string_split(row, chr(10))))) AS place FROM d),
t AS (
  SELECT row, place, line,
    regexp_split_to_array(regexp_replace(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[\x20\x09-\x0D]+') AS tokens
  FROM l),
h AS (
  SELECT row, place, tokens, len(tokens) AS n, array_to_string(tokens, ' ') AS template,
    len(tokens)::VARCHAR || ' ' || array_to_string(tokens[1:4], ' ') AS leaf, md5(line) AS m
  FROM t WHERE len(tokens) >= 2),
n AS (
  SELECT row, place, tokens, n, template, leaf, min(m) OVER w AS k0, min(m[9:] || m[1:8]) OVER w AS k1,
    min(m[17:] || m[1:16]) OVER w AS k2, min(m[25:] || m[1:24]) OVER w AS k3
  FROM h WINDOW w AS (PARTITION BY row)),
whole AS (
  SELECT template FROM n GROUP BY template
  HAVING greatest(count(DISTINCT k0), count(DISTINCT k1), count(DISTINCT k2), count(DISTINCT k3)) >= 3 AND 2 * greatest(count(DISTINCT k0), count(DISTINCT k1), count(DISTINCT k2), count(DISTINCT k3)) >= count(DISTINCT row)),
o AS (SELECT * FROM n WHERE template NOT IN (SELECT template FROM whole)),
big AS (SELECT leaf FROM o GROUP BY leaf HAVING greatest(count(DISTINCT k0), count(DISTINCT k1), count(DISTINCT k2), count(DISTINCT k3)) >= 3),
s AS (
  SELECT row, place, k0, k1, k2, k3, leaf, n, unnest(list_transform(range(1, n + 1), lambda i: {'i': i, 'token': tokens[i],
    'before': CASE WHEN i > 1 THEN tokens[i - 1] ELSE '' END, 'behind': CASE WHEN i < n THEN tokens[i + 1] ELSE '' END}), recursive := true)
  FROM o WHERE leaf IN (SELECT leaf FROM big)),
seen AS (SELECT leaf, i, before, token, behind, count(*) AS times FROM s GROUP BY ALL),
shares AS (
  SELECT leaf, i, before, token, behind, sum(times) OVER (PARTITION BY leaf, i, token) AS often,
    sum(times) OVER (PARTITION BY leaf, i, before, token) AS led, sum(times) OVER (PARTITION BY leaf, i, before) AS led_all,
    sum(times) OVER (PARTITION BY leaf, i, token, behind) AS followed, sum(times) OVER (PARTITION BY leaf, i, behind) AS followed_all
  FROM seen),
fixed AS (SELECT leaf, i, before, token, behind FROM shares WHERE often >= 3 AND 100 * led > 50 * led_all AND 100 * followed > 50 * followed_all),
g AS (
  SELECT row, place, k0, k1, k2, k3, leaf, string_agg(i::VARCHAR || ':' || token, ' ' ORDER BY i) AS name
  FROM s JOIN fixed USING (leaf, i, before, token, behind) GROUP BY row, place, k0, k1, k2, k3, leaf, n HAVING 100 * count(*) >= 70 * n),
general AS (
  SELECT leaf, name FROM g GROUP BY leaf, name
  HAVING greatest(count(DISTINCT k0), count(DISTINCT k1), count(DISTINCT k2), count(DISTINCT k3)) >= 3 AND 2 * greatest(count(DISTINCT k0), count(DISTINCT k1), count(DISTINCT k2), count(DISTINCT k3)) >= count(DISTINCT row)),
hit AS (
  SELECT row, place FROM n WHERE template IN (SELECT template FROM whole)
  UNION SELECT row, place FROM g JOIN general USING (leaf, name)),
c AS (
  SELECT l.row, count(*)::BIGINT AS n_lines, count(hit.place)::BIGINT AS n_dropped,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.place) FILTER (hit.place IS NULL), '') AS left_text
  FROM l LEFT JOIN hit USING (row, place) GROUP BY l.row)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE left_text END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped
FROM documents LEFT JOIN c ON c.row = text
"""


@query("op1_line_dedup", SQL)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=("n_lines", "n_dropped"))
