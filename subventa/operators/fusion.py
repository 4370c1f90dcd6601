"""Rank assignment and reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fusion constant (fixed value).
RRF_K = 60


def first_ranks(ranked: DataFrame, id_col: str = "grant_id") -> DataFrame:
    """First position per id where a list repeats one."""
    return ranked.groupBy("qid", id_col).agg(F.min("rank").alias("rank"))


def reciprocal_rank_fusion(dense: DataFrame, sparse: DataFrame, k: int = RRF_K) -> DataFrame:
    """(qid, grant_id, rrf_score, dense_rank, sparse_rank, fused_rank).

    Both inputs carry qid, grant_id and a 0-based rank.
    """
    d = first_ranks(dense).withColumnRenamed("rank", "dense_rank")
    s = first_ranks(sparse).withColumnRenamed("rank", "sparse_rank")
    score = F.coalesce(1.0 / (F.col("dense_rank") + k + 1), F.lit(0.0)) + F.coalesce(
        1.0 / (F.col("sparse_rank") + k + 1), F.lit(0.0)
    )
    order = Window.partitionBy("qid").orderBy(
        F.desc("rrf_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), F.col("grant_id")
    )
    return (
        d.join(s, ["qid", "grant_id"], "full_outer")
        .withColumn("rrf_score", score)
        .withColumn("fused_rank", F.row_number().over(order) - 1)
    )
