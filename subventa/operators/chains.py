"""Chains of prerequisites: what a programme unlocks, step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subventa.sources.shared import shared_path, stored


def shortest_chains(edges: DataFrame) -> DataFrame:
    """(start, end, steps): the fewest steps from a programme to each it leads to; (x, x) where x lies on a circle.

    `edges` has columns start and end of one type; rows with a null, and repeats, count for nothing. Every round goes
    one step on from the pairs found last and leaves out known ones, so circles end and a pair is found once, by its
    shortest chain. Rounds are as many as the longest of the shortest chains has steps; each is written.
    """
    spark = edges.sparkSession
    steps = stored(edges.select("start", "end").filter("start is not null and end is not null").distinct(), shared_path(spark, "edges"))
    on = steps.select(F.col("start").alias("end"), F.col("end").alias("next"))
    found = [last] = [stored(steps.withColumn("steps", F.lit(1)), shared_path(spark, "chains"))]
    while last.take(1):
        known = found[0]
        for part in found[1:]:
            known = known.unionByName(part)
        further = last.join(on, "end").select("start", F.col("next").alias("end")).distinct()
        fresh = further.join(known.select("start", "end"), ["start", "end"], "left_anti").withColumn("steps", F.lit(len(found) + 1))
        last = stored(fresh, shared_path(spark, "chains"))
        found.append(last)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def on_circles(chains: DataFrame) -> DataFrame:
    """(programme, steps): programmes that are their own prerequisite, and over how many steps."""
    return chains.filter("start = end").select(F.col("start").alias("programme"), "steps")
