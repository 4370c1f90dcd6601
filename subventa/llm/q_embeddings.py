"""Query op3: near-duplicate vectors of one label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from subventa.llm.registry import query, table
from subventa.llm.subspace import near_vectors


@query("op3_subspace_near_dedup")
def op3_subspace_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)
