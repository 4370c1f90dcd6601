"""Query op4: conversations as reply trees of one branch, formatted and read back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subventa.llm.chat import conversations_of, read_back, unescape
from subventa.llm.registry import query, table

ODD_TEXT = r"\### Assistant: </turn> ok"

SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS et,
    replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS er
  FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(er) + length(et) + 13)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for conv, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            turns = read_back(text)
            loss = "".join(unescape(text[start:end]) for role, _, start, end in turns if role == "assistant")
            out["conv_id"].append(conv)
            out["n_turns"].append(len(turns))
            out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t, _, _ in turns).encode()).hexdigest())
            out["loss_chars"].append(len(loss))
            out["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
            out["formatted_chars"].append(len(text))
        yield pa.RecordBatch.from_pydict(out)


def as_trees(rows: DataFrame) -> DataFrame:
    """Each conversation as a tree of one branch: a turn answers the one before.

    Turns without a conv_id are one conversation, as in SQL groups. It stands beside conversation 0 in a tree, with
    negative node ids, which no other turn has.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    place = F.row_number().over(order)
    sign = F.when(F.col("conv_id").isNull(), -1).otherwise(1)
    return rows.select(
        F.coalesce("conv_id", F.lit(0)).alias("tree_id"), (sign * place).alias("node_id"), F.when(place > 1, sign * (place - 1)).alias("parent_id"), "role", "text", F.lit(0.0).alias("score")
    )


@query("op4_chat_format", SQL)
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    rows = table(spark, sf_dir, "conversations").select(*columns)
    odd = spark.createDataFrame([(-7, 0, "user", ODD_TEXT), (-7, 1, "assistant", ODD_TEXT)], "conv_id long, turn long, role string, text string")
    rows = rows.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))}).union(odd)
    chats = conversations_of(as_trees(rows)).select(F.when(F.col("leaf") > 0, F.col("tree_id")).alias("conv_id"), "formatted")
    return chats.mapInArrow(
        _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
