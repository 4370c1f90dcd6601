"""Query op6: packing of all documents into sequences of 1024 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from subventa.llm.packing import packed
from subventa.llm.registry import query, table


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
