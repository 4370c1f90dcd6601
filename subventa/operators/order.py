"""Order-based operators that do not put one hot key into one task.

A plain window over a key sorts the whole key in one task. Here the key's rows
are cut into blocks of the order column; a block is windowed on its own and
only one small row per block travels to the per-key step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocked_lag(
    df: DataFrame, keys: list[str], order: list[str], value: str, block: Column, out: str
) -> DataFrame:
    """Previous `value` per key in order; null for a key's first row.

    `block` must not decrease along `order`, and `value` must not be null.
    """
    cut = df.withColumn("_block", block)
    inner = Window.partitionBy(*keys, "_block").orderBy(*order)
    within = cut.withColumn("_lag", F.lag(value).over(inner))
    last = (
        cut.groupBy(*keys, "_block")
        .agg(F.max_by(F.col(value), F.struct(*order)).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block")))
        .drop("_last")
    )
    return (
        within.join(last, [*keys, "_block"], "left")
        .withColumn(out, F.coalesce("_lag", "_carry"))
        .drop("_block", "_lag", "_carry")
    )


def blocked_rank(df: DataFrame, keys: list[str], order: list[Column], block: Column, out: str) -> DataFrame:
    """0-based position per key in order; `block` must not decrease along `order`."""
    cut = df.withColumn("_block", block)
    sizes = cut.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (
        cut.withColumn("_pos", F.row_number().over(inner) - 1)
        .join(offsets, [*keys, "_block"])
        .withColumn(out, F.col("_pos") + F.col("_offset"))
        .drop("_block", "_pos", "_offset")
    )


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best k rows per key with a 0-based rank.

    Spark keeps at most k rows per key and task before the shuffle
    (WindowGroupLimit), so a hot key stays small.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).withColumn(
        rank, (F.col("_rn") - 1).cast("int")
    ).drop("_rn")

