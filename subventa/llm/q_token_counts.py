"""Query op13: tokens of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from subventa.llm.registry import query, table
from subventa.llm.token_counts import token_counts


@query("op13_token_counts")
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
