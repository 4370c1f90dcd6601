"""One ingest run: pages to records, outcomes, ledger rows and the next snapshot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subventa.operators.extract import extract_records, with_rejections
from subventa.operators.ingest import (
    FAILED,
    classify_arrivals,
    run_counters,
    upsert_changes,
    upsert_snapshot,
    with_hash,
    with_run_status,
)


@dataclass(frozen=True)
class IngestRun:
    outcomes: DataFrame
    rejects: DataFrame
    ledger: DataFrame
    snapshot: DataFrame
    changes: DataFrame


def arrivals_of(records: DataFrame) -> DataFrame:
    """Validated records as arrivals; page_id orders repeated urls."""
    missing = {"title_en": "string", "summary_en": "string", "sector": "string"}
    out = records.withColumnRenamed("page_id", "arrival")
    for name, kind in missing.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return with_hash(out)


def ingest_pages(pages: DataFrame, target: DataFrame, run_id: Column, now: Column, checked: DataFrame | None = None) -> IngestRun:
    """Plans one run over pages (page_id, url, portal, html) against `target`.

    Pages that cannot be read or validated count as failed. Pass `checked`
    (with_rejections over extract_records, stored) to extract the pages once.
    `changes` are the rows to append to a delta table; for them, a target of
    the touched urls alone is enough.
    """
    if checked is None:
        checked = with_rejections(extract_records(pages))
    rejects = checked.filter(F.size("reasons") > 0)
    arrivals = arrivals_of(checked.filter(F.size("reasons") == 0).drop("reasons", "parse_error"))
    acted = classify_arrivals(arrivals, target)
    outcomes = acted.select("portal", "source_url", "arrival", "action").unionByName(
        rejects.select("portal", "source_url", F.col("page_id").alias("arrival"), F.lit(FAILED).alias("action"))
    )
    ledger = with_run_status(run_counters(outcomes.withColumn("run_id", run_id)))
    return IngestRun(outcomes, rejects, ledger, upsert_snapshot(target, arrivals, now), upsert_changes(target, arrivals, now))
