"""Folds over user events: request rates, recent searches, saved items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subventa.functions.text import strip
from subventa.operators.order import top_per_key

# Window, allowance and unmetered paths (fixed values).
WINDOW_SECONDS = 60
PER_MINUTE = 60
BURST = 20
HEALTH_PATHS = ("/health", "/healthz", "/ready")
RECENT_LIMIT = 8


def request_rates(
    hits: DataFrame,
    order: list[str],
    window_seconds: int = WINDOW_SECONDS,
    limit: int = PER_MINUTE + BURST,
    exempt: tuple[str, ...] = HEALTH_PATHS,
    block_seconds: int | None = None,
) -> DataFrame:
    """Adds `in_window` (hits of the identity in the window, itself included) and `limited`.

    `hits`: identity, ts, path plus the unique `order` columns. Rejected hits
    count, unmetered paths do not. An identity is first summed per second and
    then cut into time blocks that also see the seconds before them, so even
    one that sends most hits is spread over tasks.
    """
    span = block_seconds or max(3600, 10 * window_seconds)
    metered = hits.filter(~F.col("path").isin(*exempt)).withColumn("_sec", F.unix_seconds(F.col("ts").cast("timestamp")))
    seconds = metered.groupBy("identity", "_sec").agg(F.count(F.lit(1)).alias("_n"))
    own = F.floor(F.col("_sec") / span)
    last_seen = F.floor((F.col("_sec") + window_seconds - 1) / span)
    spread = seconds.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(own, last_seen)))
    # Hits come in with their second and go out once the window has passed. So one running sum gives
    # the hits before a second; a sliding frame would add its rows up again for every second.
    comes = F.struct(F.col("_sec").alias("at"), F.lit(1).alias("kind"), F.col("_n").alias("change"))
    goes = F.struct((F.col("_sec") + window_seconds).alias("at"), F.lit(0).alias("kind"), (-F.col("_n")).alias("change"))
    steps = spread.select("identity", "_block", "_own", F.explode(F.array(comes, goes)).alias("_s"))
    before = Window.partitionBy("identity", "_block").orderBy("_s.at", "_s.kind").rowsBetween(Window.unboundedPreceding, -1)
    earlier = (
        steps.withColumn("_earlier", F.coalesce(F.sum("_s.change").over(before), F.lit(0)))
        .filter((F.col("_s.kind") == 1) & (F.col("_block") == F.col("_own")))
        .select("identity", F.col("_s.at").alias("_sec"), "_earlier")
    )
    peers = Window.partitionBy("identity", "_sec").orderBy(*order)
    count = F.col("_earlier") + F.row_number().over(peers)
    return (
        metered.join(earlier, ["identity", "_sec"])
        .withColumn("in_window", count.cast("bigint"))
        .withColumn("limited", F.col("in_window") > limit)
        .drop("_sec", "_earlier")
    )


def recent_searches(searches: DataFrame, order: list[str], limit: int = RECENT_LIMIT) -> DataFrame:
    """Newest distinct searches per user; case and outer white space do not distinguish."""
    trimmed = strip(F.col("query"))
    named = searches.withColumn("query", trimmed).filter(F.col("query") != "")
    latest = named.groupBy("user_id", F.lower("query").alias("_norm")).agg(
        F.max(F.struct(*order, "query")).alias("_m")
    )
    flat = latest.select("user_id", "_m.*")
    return top_per_key(flat, ["user_id"], [F.desc(c) for c in order], limit)


def saved_items(events: DataFrame, order: list[str], action: Column) -> DataFrame:
    """(user_id, item_id, saved_at...): items toggled on since the last clear or removal.

    `action` is 'toggle', 'remove' or 'clear' per event.
    """
    at = F.struct(*order)
    rows = events.select("user_id", "item_id", action.alias("_action"), at.alias("_at"))
    clears = rows.filter(F.col("_action") == "clear").groupBy("user_id").agg(F.max("_at").alias("_cleared"))
    removals = (
        rows.filter(F.col("_action") == "remove").groupBy("user_id", "item_id").agg(F.max("_at").alias("_removed"))
    )
    toggles = rows.filter(F.col("_action") == "toggle").drop("_action").join(clears, "user_id", "left")
    since_clear = toggles.filter(F.col("_cleared").isNull() | (F.col("_at") > F.col("_cleared")))
    pair = F.struct("user_id", "item_id")
    since = since_clear.withColumn("_pair", pair).join(removals.select(pair.alias("_pair"), "_removed"), "_pair", "left").filter(F.col("_removed").isNull() | (F.col("_at") > F.col("_removed")))
    kept = since.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("_n"), F.max("_at").alias("_last"))
    return kept.filter(F.col("_n") % 2 == 1).select("user_id", "item_id", "_last.*")
