"""Row numbers of large tables without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subventa.llm.store import materialise


def numbered(df: DataFrame, within: list[str], order: list[Column], name: str) -> DataFrame:
    """`df` with `idx` (from 0 in the order of `order`) and `n` (how many) among rows of equal `within`.

    Rows are sorted over ranges of (within, order) and written with their block and their
    place in it; a block's offset is the number of rows in the blocks before, so only one
    row per block and key meets a window. A key with many rows spans many blocks. `within`
    must not be null; of rows that are equal in `order`, any may come first. `df` must not
    have columns block_, at_, first_, before_, idx or n.
    """
    keys = [F.col(c) for c in within]
    by_place = [*keys, *order]
    placed = materialise(
        df.repartitionByRange(*by_place)
        .sortWithinPartitions(*by_place)
        .withColumns({"block_": F.spark_partition_id(), "at_": F.monotonically_increasing_id()}),
        name,
    )
    sums = placed.groupBy(*within, "block_").agg(F.count(F.lit(1)).alias("n_"), F.min("at_").alias("first_"))
    whole = Window.partitionBy(*within)
    earlier = whole.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *within, "block_", "first_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("before_"), F.sum("n_").over(whole).alias("n")
    )
    return (
        placed.join(sums, [*within, "block_"])
        .withColumn("idx", F.col("before_") + F.col("at_") - F.col("first_"))
        .drop("block_", "at_", "first_", "before_")
    )
