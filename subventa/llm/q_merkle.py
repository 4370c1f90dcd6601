"""Query op11: leaves, proofs and roots of the documents, some of them tampered with."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subventa.llm import merkle
from subventa.llm.registry import query, table

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
LEVELS_OF_SOURCE, LEVELS_OF_ROOT = 7, 4

_LEAF = "sha256(" + " || ".join(
    f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR END" for c in FIELDS
) + ")"
# CRC-32 of short ASCII strings bit by bit: a byte is xored in (entries from 0), then eight shifts (entries of -1).
_CRC = """xor(4294967295, list_reduce(
    flatten(list_transform(string_split({0}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, 4294967295::BIGINT))"""


def _level(k: int, trees: str, prefix: str) -> str:
    """Runs of level k, and the nodes above; a tree of one node stays as it is."""
    node, above, run = f"{prefix}{k}", f"{prefix}{k + 1}", f"{prefix}r{k}"
    return f"""
{run} AS (SELECT {trees}, i // 16 AS run, list(h ORDER BY i) AS hs, any_value(n) AS n FROM {node} GROUP BY {trees}, i // 16),
{above} AS (SELECT {trees}, run AS i, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, (n + 15) // 16 AS n FROM {run}),"""


def _step(k: int, last: str, prefix: str, place: str, join: str) -> str:
    """Proof and fold of every document through level k."""
    before, after = f"array_to_string(hs[1:{place}], '')", f"array_to_string(hs[{place} + 2:], '')"
    return f"""
f{prefix}{k} AS (
  SELECT f.* EXCLUDE (proof, node), proof || {before} || {after} AS proof,
    CASE WHEN r.n = 1 THEN node ELSE sha256({before} || node || {after}) END AS node
  FROM {last} f JOIN {prefix}r{k} r ON {join}),"""


def _sql() -> str:
    parts = [f"""
WITH w AS (
  SELECT *, coalesce('=' || source, '') AS tree, {_LEAF} AS leaf,
    CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 5 = 0 THEN translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}') ELSE text END AS altered
  FROM documents),
l AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n,
    {_LEAF.replace("text", "altered")} AS now
  FROM w),
a0 AS (SELECT tree, i, leaf AS h, n FROM l),"""]
    parts += [_level(k, "tree", "a") for k in range(LEVELS_OF_SOURCE)]
    parts.append(f"""
s AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM a{LEVELS_OF_SOURCE}),
b0 AS (SELECT 0 AS one, i, subroot AS h, n FROM s),""")
    parts += [_level(k, "one", "b") for k in range(LEVELS_OF_ROOT)]
    parts.append("""
f AS (SELECT l.doc_id, l.leaf, l.tree, l.i, s.i AS si, s.subroot, '' AS proof, l.now AS node FROM l JOIN s USING (tree)),""")
    last = "f"
    for k in range(LEVELS_OF_SOURCE):
        parts.append(_step(k, last, "a", f"(f.i // {16**k} % 16)", f"r.tree = f.tree AND r.run = f.i // {16 ** (k + 1)}"))
        last = f"fa{k}"
    for k in range(LEVELS_OF_ROOT):
        parts.append(_step(k, last, "b", f"(f.si // {16**k} % 16)", f"r.run = f.si // {16 ** (k + 1)}"))
        last = f"fb{k}"
    parts.append(f"""
root AS (SELECT h AS root FROM b{LEVELS_OF_ROOT})
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified FROM {last}, root
""")
    return "".join(parts)


# Holds 16**7 documents a source and 16**4 sources.
SQL = _sql()


@query("op11_merkle_manifest", SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    altered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    docs = docs.withColumns({"altered": F.when(hit, altered)})
    changed = F.when(F.col("altered").isNotNull(), merkle.leaf_digest([*FIELDS[:-1], "altered"]))
    leaves = merkle.leaves_of(docs, FIELDS, "source", "doc_id", changed)
    rows = merkle.sealed(leaves)
    return rows.select(F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", "verified")
