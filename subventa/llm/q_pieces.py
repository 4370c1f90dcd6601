"""Query op2: the four best segmentations of every document, decoded again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from subventa.llm.pieces import digests, segmentations
from subventa.llm.registry import query, table


@query("op2_piece_nbest")
def op2_piece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(segmentations(table(spark, sf_dir, "documents"), n=4))
