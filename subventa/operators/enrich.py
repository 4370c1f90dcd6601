"""Enrichment work list, record check, merge and tally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subventa.functions.text import strip_fences
from subventa.functions.variants import no_text, no_text_list
from subventa.schema import ELIGIBILITY, ENRICHMENT, ENRICHMENT_VERSION, FUNDING_FORMS, SECTORS

ENRICHED, SKIPPED, FAILED = "enriched", "skipped", "failed"

# Longest list and text per enrichment field (fixed values).
LIST_CAPS = {"secondary_sectors": 4, "target_groups": 6, "eligibility_criteria": 8, "funding_phases": 4}
NOTES_CAP = 600
STATE_CAP = 64


def current_version(row: Column) -> Column:
    return F.coalesce(row["enrichment_version"], F.lit(0))


def work_list(corpus: DataFrame, force: bool = False, limit: int | None = None) -> DataFrame:
    """Live rows with `due`; the limit counts rows before the version test."""
    live = corpus.filter(F.col("deleted_at").isNull())
    if limit is not None:
        live = live.orderBy("grant_id").limit(limit)
    due = F.lit(True) if force else current_version(F.col("eligibility")) < ENRICHMENT_VERSION
    return live.withColumn("due", due)


def parse_enrichments(replies: DataFrame) -> DataFrame:
    """(grant_id, reply) to (grant_id, e, reasons); defaults as declared."""
    parsed = replies.withColumn("e", F.from_json(strip_fences(F.col("reply")), ENRICHMENT))
    empty = F.array().cast("array<string>")
    filled = parsed.withColumn(
        "e",
        F.when(
            F.col("e").isNotNull(),
            F.struct(
                F.col("e.sector").alias("sector"),
                F.coalesce("e.secondary_sectors", empty).alias("secondary_sectors"),
                F.col("e.federal_state").alias("federal_state"),
                F.coalesce("e.target_groups", empty).alias("target_groups"),
                F.coalesce("e.eligibility_criteria", empty).alias("eligibility_criteria"),
                F.coalesce("e.funding_phases", empty).alias("funding_phases"),
                F.coalesce("e.funding_form", F.lit("other")).alias("funding_form"),
                F.coalesce("e.application_notes", F.lit("")).alias("application_notes"),
            ),
        ),
    )
    return filled.withColumn("reasons", enrichment_reasons(F.col("e"), F.try_parse_json(strip_fences(F.col("reply")))))


def enrichment_reasons(e: Column, document: Column) -> Column:
    """Broken rules of one parsed record; `document` is the reply as a variant."""
    caps = [F.when(F.size(e[n]) > cap, F.lit(f"{n} longer than {cap}")) for n, cap in LIST_CAPS.items()]
    return F.array_compact(
        F.array(
            F.when(document.isNull() | ~F.schema_of_variant(document).startswith("OBJECT"), F.lit("not a record")),
            F.when(e["sector"].isNotNull() & ~e["sector"].isin(*SECTORS), F.lit("sector not allowed")),
            F.when(
                F.exists(e["secondary_sectors"], lambda s: s.isNull() | ~s.isin(*SECTORS)),
                F.lit("secondary sector not allowed"),
            ),
            F.when(~e["funding_form"].isin(*FUNDING_FORMS), F.lit("funding form not allowed")),
            F.when(F.length(e["application_notes"]) > NOTES_CAP, F.lit("application_notes too long")),
            F.when(F.length(e["federal_state"]) > STATE_CAP, F.lit("federal_state too long")),
            *caps,
            *[F.when(no_text_list(document, f"$.{n}"), F.lit(f"{n} is no list of texts")) for n in LIST_CAPS],
            *[F.when(no_text(document, f"$.{n}", nullable=True), F.lit(f"{n} is no text")) for n in ("sector", "federal_state")],
            *[F.when(no_text(document, f"$.{n}"), F.lit(f"{n} is no text")) for n in ("funding_form", "application_notes")],
        )
    )


def merge_enrichments(corpus: DataFrame, checked: DataFrame, now: Column) -> DataFrame:
    """Fill sector and state where null, replace eligibility, stamp the version.

    `checked` comes from parse_enrichments; one row per grant.
    """
    good = checked.filter(F.size("reasons") == 0).select("grant_id", "e")
    stamped = F.struct(
        F.col("e.target_groups").alias("target_groups"),
        F.col("e.eligibility_criteria").alias("criteria"),
        F.col("e.funding_phases").alias("funding_phases"),
        F.col("e.funding_form").alias("funding_form"),
        F.col("e.secondary_sectors").alias("secondary_sectors"),
        F.col("e.application_notes").alias("application_notes"),
        F.lit(ENRICHMENT_VERSION).alias("enrichment_version"),
        now.alias("enriched_at"),
    ).cast(ELIGIBILITY)
    hit = F.col("e").isNotNull()
    return (
        corpus.join(good, "grant_id", "left")
        .withColumns(
            {
                "sector": F.coalesce("sector", "e.sector"),
                "federal_state": F.coalesce("federal_state", F.nullif(F.col("e.federal_state"), F.lit(""))),
                "eligibility": F.when(hit, stamped).otherwise(F.col("eligibility")),
            }
        )
        .drop("e")
    )


def enrichment_outcomes(work: DataFrame, checked: DataFrame) -> DataFrame:
    """Status per work-list row: skipped when current, failed without a valid record."""
    good = checked.select("grant_id", (F.size("reasons") == 0).alias("ok"))
    return work.join(good, "grant_id", "left").select(
        "grant_id",
        F.when(~F.col("due"), SKIPPED).when(F.col("ok"), ENRICHED).otherwise(FAILED).alias("status"),
    )


def enrichment_tally(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
