"""Tolerant normalisation of model-written labels and of display buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from subventa.functions.text import strip

# Price per million tokens in USD (fixed values).
INPUT_USD_PER_MTOK = 0.075
OUTPUT_USD_PER_MTOK = 0.30


def fit_label(raw: Column) -> Column:
    s = strip(F.lower(raw))
    return (
        F.when(s.startswith("high") | (s == "h"), "high")
        .when(s.startswith("med") | (s == "m"), "medium")
        .otherwise("low")
    )


def severity(raw: Column) -> Column:
    s = strip(F.lower(raw))
    return (
        F.when(s.startswith("high") | s.isin("critical", "blocker"), "high")
        .when(s.startswith("med") | s.startswith("mod"), "medium")
        .otherwise("low")
    )


def clamp_score(raw: Column) -> Column:
    """Half-even round, clipped to 0..100; unreadable becomes 0."""
    # The cast alone also takes Java's suffixes and hexadecimal floats.
    number = raw.rlike(r"(?i)^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?\s*$") | raw.rlike(r"(?i)^\s*[+-]?(inf|infinity|nan)\s*$")
    value = F.nanvl(F.when(number, raw.try_cast("double")), F.lit(0.0))
    clipped = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(value, F.lit(0.0))))
    return F.bround(clipped, 0).cast("int")


def token_cost_usd(input_tokens: Column, output_tokens: Column) -> Column:
    return input_tokens * F.lit(INPUT_USD_PER_MTOK) / F.lit(1e6) + output_tokens * F.lit(
        OUTPUT_USD_PER_MTOK
    ) / F.lit(1e6)


def half_up(value: Column) -> Column:
    """Round halves towards plus infinity."""
    return F.floor(value + F.lit(0.5)).cast("bigint")


def days_left(deadline: Column, as_of: Column) -> Column:
    micros = F.unix_micros(deadline) - F.unix_micros(as_of)
    return half_up(micros / F.lit(86_400_000_000.0))


def deadline_bucket(deadline: Column, as_of: Column) -> Column:
    days = days_left(deadline, as_of)
    return (
        F.when(deadline.isNull(), "rolling")
        .when(days < 0, "closed")
        .when(days <= 30, "closing_soon")
        .otherwise("later")
    )
