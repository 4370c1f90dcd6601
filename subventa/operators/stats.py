"""Funding statistics over the live corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subventa.functions.labels import half_up
from subventa.operators.corpus import live

_MONEY = "decimal(14,2)"


def _ceiling() -> Column:
    return F.col("funding_max_eur").cast(_MONEY)


def _spread(prefix: str = "funding_") -> list[Column]:
    """min / max / avg of the ceiling as double; the sum is exact in decimal."""
    c = _ceiling()
    mean = F.sum(c).cast("double") / F.nullif(F.count(c), F.lit(0))
    return [
        F.min(c).cast("double").alias(f"{prefix}min"),
        F.max(c).cast("double").alias(f"{prefix}max"),
        mean.alias(f"{prefix}avg"),
    ]


def totals(corpus: DataFrame) -> DataFrame:
    return live(corpus).agg(
        F.count(F.lit(1)).alias("total_grants"),
        F.count("embedding").alias("embedded_grants"),
        *_spread("funding_global_"),
    )


def by_portal(corpus: DataFrame) -> DataFrame:
    return live(corpus).groupBy("portal").agg(
        F.count(F.lit(1)).alias("n"), F.count("funding_max_eur").alias("n_with_funding_max"), *_spread()
    )


def by_status(corpus: DataFrame) -> DataFrame:
    return live(corpus).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def by_federal_state(corpus: DataFrame) -> DataFrame:
    known = live(corpus).filter(F.col("federal_state").isNotNull())
    return known.groupBy("federal_state").agg(F.count(F.lit(1)).alias("n"))


TOTAL, PORTAL, STATUS, STATE = "total", "portal", "status", "federal_state"


def rollup_blocks(corpus: DataFrame) -> DataFrame:
    """All four statistics from one scan of the corpus: (block, key, n, ...).

    Grouping sets over portal, status and state replace four passes; a null
    state is excluded after the aggregation, where it is a single row.
    """
    rows = live(corpus).select(
        "portal",
        "status",
        "federal_state",
        F.col("embedding").isNotNull().alias("embedded"),
        _ceiling().alias("funding_max_eur"),
    )
    c, keys = F.col("funding_max_eur"), ("portal", "status", "federal_state")
    # Summed per combination first: few rows are left to be spread over the sets.
    fine = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("embedded")).alias("n_embedded"),
        F.count(c).alias("n_with_funding_max"),
        F.min(c).alias("_min"),
        F.max(c).alias("_max"),
        F.sum(c).alias("_sum"),
    )
    counted = F.sum("n_with_funding_max")
    sets = [[], [F.col("portal")], [F.col("status")], [F.col("federal_state")]]
    grouped = fine.groupingSets(sets, *keys).agg(
        F.grouping_id().alias("_gid"),
        F.sum("n").alias("n"),
        F.sum("n_embedded").alias("n_embedded"),
        counted.alias("n_with_funding_max"),
        F.min("_min").cast("double").alias("funding_min"),
        F.max("_max").cast("double").alias("funding_max"),
        (F.sum("_sum").cast("double") / F.nullif(counted, F.lit(0))).alias("funding_avg"),
    )
    # grouping_id has one bit per column, set where the column is aggregated away
    block = (
        F.when(F.col("_gid") == 7, TOTAL).when(F.col("_gid") == 3, PORTAL).when(F.col("_gid") == 5, STATUS).otherwise(STATE)
    )
    out = grouped.select(
        block.alias("block"),
        F.coalesce("portal", "status", "federal_state").alias("key"),
        "n",
        "n_embedded",
        "n_with_funding_max",
        "funding_min",
        "funding_max",
        "funding_avg",
    )
    return out.filter((F.col("block") != STATE) | F.col("key").isNotNull())


def statistics_document(corpus: DataFrame) -> DataFrame:
    """One row: totals as a struct and the three breakdowns as arrays.

    The arrays hold one entry per portal, status and state. An empty corpus
    gives zero counts, null amounts and empty arrays.
    """
    blocks = rollup_blocks(corpus)

    def entries(block: str, *fields: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("block") == block, F.struct(*fields))))

    def of_total(c: str) -> Column:
        return F.max(F.when(F.col("block") == TOTAL, F.col(c)))

    key, n = F.col("key"), F.col("n")
    return blocks.agg(
        F.struct(
            F.coalesce(of_total("n"), F.lit(0)).alias("total_grants"),
            F.coalesce(of_total("n_embedded"), F.lit(0)).alias("embedded_grants"),
            of_total("funding_min").alias("funding_global_min"),
            of_total("funding_max").alias("funding_global_max"),
            of_total("funding_avg").alias("funding_global_avg"),
        ).alias("totals"),
        entries(
            PORTAL, key.alias("portal"), n, F.col("n_with_funding_max"), F.col("funding_min"), F.col("funding_max"),
            F.col("funding_avg"),
        ).alias("by_portal"),
        entries(STATUS, key.alias("status"), n).alias("by_status"),
        entries(STATE, key.alias("federal_state"), n).alias("by_federal_state"),
    )


def statistics_json(corpus: DataFrame) -> DataFrame:
    doc = statistics_document(corpus)
    keep_nulls = {"ignoreNullFields": "false"}
    return doc.select(*[F.to_json(c, keep_nulls).alias(c) for c in doc.columns])


def embedded_share(totals_row: DataFrame) -> DataFrame:
    pct = F.coalesce(F.try_divide(F.col("embedded_grants") * 100.0, F.col("total_grants")), F.lit(0.0))
    return totals_row.select("total_grants", "embedded_grants", half_up(pct).alias("embedded_pct"))


def distribution(counts: DataFrame, label: str) -> DataFrame:
    """Share of all rows and bar width against the largest, in percent.

    `counts` has one row per group, so the unpartitioned window stays small.
    """
    whole = Window.partitionBy()
    total, top = F.sum("n").over(whole), F.max("n").over(whole)
    order = Window.orderBy(F.desc("n"), F.col(label))
    return counts.select(
        label,
        "n",
        half_up(F.col("n") / total * 100).alias("pct"),
        half_up(F.col("n") / top * 100).alias("bar_width"),
        F.row_number().over(order).alias("position"),
    )


def rank_by_average(portals: DataFrame) -> DataFrame:
    return portals.filter(F.col("funding_avg") > 0).orderBy(F.desc("funding_avg"), F.col("portal"))


def rank_by_count(portals: DataFrame) -> DataFrame:
    return portals.orderBy(F.desc("n"), F.col("portal"))
