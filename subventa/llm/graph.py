"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subventa.llm.store import materialise


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (a, b) with a < b, loops left out."""
    return (
        df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct()
    )


def _to_smallest(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step: neighbours meet the smallest id of their neighbourhood.

    The large step moves the larger neighbours of every node, the small step the
    smaller ones and the node itself. Only minima are aggregated, so a hub with
    many neighbours is never collected.
    """
    if large:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        moved = pairs.join(least, pairs["a"] == least["u"]).select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        least = pairs.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        moved = pairs.join(least, pairs["b"] == least["u"]).select(F.col("a").alias("x"), F.col("m").alias("y"))
        moved = moved.union(least.select(F.col("u").alias("x"), F.col("m").alias("y")))
    return _pairs(moved, "x", "y")


def _mark(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable by links, for every id that has a link to another.

    Large and small star steps in turn until nothing moves; the table of a round
    is written to the shared folder. Rows with a null id are no links.
    """
    pairs = materialise(_pairs(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b), "links")
    before = _mark(pairs)
    while before[0]:
        pairs = materialise(_to_smallest(_to_smallest(pairs, large=True), large=False), "links")
        after = _mark(pairs)
        if after == before:
            break
        before = after
    leaves = pairs.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return leaves.union(pairs.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
