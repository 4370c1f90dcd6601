"""Token costs and stage traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subventa.functions.labels import token_cost_usd

STAGES = ("planner", "retrieval", "scorer", "writer", "critic")


def cost_rollup(calls: DataFrame) -> DataFrame:
    """Tokens and cost per model and day. `calls`: model, ts, input_tokens, output_tokens."""
    sums = calls.groupBy("model", F.to_date("ts").alias("day")).agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")
    )
    return sums.withColumn("usd_cost", token_cost_usd(F.col("input_tokens"), F.col("output_tokens")))


def stage_trace(stage_events: DataFrame, order: list[str]) -> DataFrame:
    """One row per request from its stage events; attempts of a stage add up.

    `stage_events`: request_id, stage, elapsed_ms, attempt, candidate_count,
    overall_pass and the `order` columns that decide the last verdict.
    """

    def spent(stage: str) -> Column:
        total = F.sum(F.when(F.col("stage") == stage, F.col("elapsed_ms")))
        return F.coalesce(total, F.lit(0)).cast("bigint").alias(f"{stage}_ms")

    critic = F.when((F.col("stage") == "critic") & F.col("overall_pass").isNotNull(), F.struct(*order, "overall_pass"))
    return stage_events.groupBy("request_id").agg(
        *[spent(s) for s in STAGES],
        F.coalesce(F.sum("elapsed_ms"), F.lit(0)).cast("bigint").alias("total_ms"),
        F.coalesce(F.max(F.when(F.col("stage") == "retrieval", F.col("candidate_count"))), F.lit(0))
        .cast("bigint")
        .alias("candidate_count"),
        F.coalesce(F.max(critic)["overall_pass"], F.lit(True)).alias("critic_pass"),
        F.greatest(F.coalesce(F.max(F.when(F.col("stage") == "writer", F.col("attempt"))), F.lit(1)), F.lit(1))
        .cast("bigint")
        .alias("writer_attempts"),
    )
