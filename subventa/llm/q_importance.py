"""Query op12: documents drawn towards the benchmark texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from subventa.llm import importance
from subventa.llm.registry import query, table

# The CRC-32 of a gram is the exclusive or of what each byte becomes when so many bytes follow it, and of the same for the start value.
SQL = r"""
WITH RECURSIVE x AS (
  SELECT 'd' AS kind, row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT 'b', -row_number() OVER (), NULL, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
g AS (
  SELECT kind, row, unnest(list_concat(ws,
    list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
    list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS gram
  FROM x),
d AS (SELECT gram, hex(encode(gram)) AS bytes, octet_length(encode(gram)) AS size FROM (SELECT DISTINCT gram FROM g)),
t AS (
  SELECT b, list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) AS v
  FROM (SELECT unnest(range(256)) AS b)),
k(j, b, v) AS (
  SELECT 0, b, v FROM t
  UNION ALL
  SELECT k.j + 1, k.b, xor(t.v, k.v // 256) FROM k JOIN t ON t.b = k.v % 256 WHERE k.j < (SELECT max(size) FROM d)),
z(j, v) AS (
  SELECT 0, 4294967295::BIGINT
  UNION ALL
  SELECT z.j + 1, xor(t.v, z.v // 256) FROM z JOIN t ON t.b = z.v % 256 WHERE z.j < (SELECT max(size) FROM d)),
pairs AS (SELECT gram, size, unnest(range(size)) AS i, bytes FROM d),
kx AS (SELECT j, printf('%02X', b) AS pair, v FROM k),
c AS (
  SELECT gram, xor(xor(bit_xor(kx.v), any_value(z.v)), 4294967295) % 10000 AS bucket
  FROM pairs JOIN kx ON kx.j = size - 1 - i AND kx.pair = substr(bytes, 2 * i + 1, 2) JOIN z ON z.j = size GROUP BY gram),
f AS (SELECT kind, row, bucket, count(*) AS n FROM g JOIN c USING (gram) GROUP BY kind, row, bucket),
n AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0) AS s, coalesce(sum(n) FILTER (kind = 'b'), 0) AS t FROM f GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM n),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1) * (t2.s_all + 10000))::DOUBLE / ((s + 1) * (t2.t_all + 10000))::DOUBLE))::BIGINT AS gain FROM n, a t2),
w AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM f JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY row),
sc AS (
  SELECT doc_id, coalesce(len(ws), 0) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM x LEFT JOIN w USING (row) WHERE kind = 'd'),
r AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS place,
    count(*) OVER (PARTITION BY n_words >= 20) AS n_enough
  FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n_enough // 100 THEN place END::BIGINT AS rank FROM r
"""


@query("op12_importance_resampling", SQL)
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = importance.resampled(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")
