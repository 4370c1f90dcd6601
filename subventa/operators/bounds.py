"""Size checks that must pass before anything is broadcast."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ranked hits that may be broadcast (id, score and ranks, some 60 bytes each).
MAX_BROADCAST_HITS = 500_000


def at_most(df: DataFrame, limit: int) -> bool:
    """True when `df` has at most `limit` rows; reads no more than that."""
    return df.limit(limit + 1).count() <= limit


def collect_within(df: DataFrame, limit: int) -> pd.DataFrame | None:
    """The rows if there are at most `limit`, else None; never fetches more than that."""
    rows = df.limit(limit + 1).toPandas()
    return rows if len(rows) <= limit else None


def broadcast_within(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast hint behind a row check, the frame itself beyond it."""
    return F.broadcast(df) if at_most(df, limit) else df


# A full input split (Spark's default).
SPLIT_BYTES = 128 * 1024 * 1024


def spread_small(df: DataFrame) -> DataFrame:
    """Spread a small input over all cores before work that is heavy per row.

    A single small file is one task. Inputs of at least one full split per core
    keep their splits and are not shuffled, so what moves here is bounded.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size < cores * SPLIT_BYTES else df
