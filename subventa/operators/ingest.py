"""Hash-gated ingest: arrivals against the current snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subventa.functions.text import content_hash, volatile_hash
from subventa.operators.order import blocked_lag
from subventa.schema import CORPUS

INSERTED, UPDATED, SKIPPED, REFRESHED, FAILED = (
    "inserted",
    "updated",
    "skipped_unchanged",
    "refreshed",
    "failed",
)

# Arrivals of one url that share a window task.
ARRIVALS_PER_BLOCK = 1_000_000


def with_hash(records: DataFrame) -> DataFrame:
    c = F.col
    return records.withColumn(
        "source_hash",
        content_hash(c("title"), c("summary"), c("body"), c("sector"), c("country"), c("federal_state")),
    )


def classify_arrivals(arrivals: DataFrame, target: DataFrame, arrivals_per_block: int = ARRIVALS_PER_BLOCK) -> DataFrame:
    """Adds `action` per arrival, in `arrival` order per url.

    `arrivals` carries source_hash; of `target` only source_url and source_hash
    are read. Just the first arrival of a url meets the target, the others
    compare with the arrival before them, so a url with many copies joins once.
    """
    block = F.floor(F.col("arrival") / F.lit(arrivals_per_block))
    chained = blocked_lag(arrivals, ["source_url"], ["arrival"], "source_hash", block, "_before")
    stored = target.select(F.col("source_url").alias("_url"), F.col("source_hash").alias("_stored"))
    # Later arrivals get a key of their own that meets no url, so they spread out.
    key = F.when(F.col("_before").isNull(), F.col("source_url")).otherwise(
        F.concat(F.lit("\u0000"), F.col("arrival").cast("string"))
    )
    joined = chained.withColumn("_key", key).join(stored, F.col("_key") == F.col("_url"), "left")
    # A stored row without a hash counts as new: the gate reads no hash there.
    previous = F.coalesce("_before", "_stored")
    return joined.withColumn(
        "action",
        F.when(previous.isNull(), INSERTED).when(previous == F.col("source_hash"), SKIPPED).otherwise(UPDATED),
    ).drop("_before", "_stored", "_key", "_url")


def last_arrivals(arrivals: DataFrame) -> DataFrame:
    """Final content per url.

    The winning arrival is found on the narrow columns, which combine map-side; only winners are joined with their
    bodies. Of rows that share url and arrival, one of those with the largest hash stays.
    """
    won = arrivals.groupBy("source_url").agg(F.max(F.struct("arrival", "source_hash")).alias("_w")).select("source_url", "_w.*")
    bodies = arrivals.join(won, ["source_url", "arrival", "source_hash"], "left_semi")
    return bodies.dropDuplicates(["source_url"]).drop("arrival")


def _volatile(prefix: str = "") -> Column:
    fields = ("status", "deadline", "funding_min_eur", "funding_max_eur")
    cast = {"funding_min_eur": "decimal(14,2)", "funding_max_eur": "decimal(14,2)"}
    return volatile_hash(*[F.col(prefix + f).cast(cast[f]) if f in cast else F.col(prefix + f) for f in fields])


def _has_eligibility(e: Column) -> Column:
    lists = ("target_groups", "criteria", "funding_phases", "secondary_sectors")
    filled = F.lit(False)
    for name in lists:
        filled = filled | (F.size(F.coalesce(e[name], F.array().cast("array<string>"))) > 0)
    for name in ("funding_form", "application_notes"):
        filled = filled | (F.coalesce(e[name], F.lit("")) != "")
    return F.coalesce(e.isNotNull() & (filled | e["enrichment_version"].isNotNull()), F.lit(False))


def _upserted(
    target: DataFrame, arrivals: DataFrame, now: Column, embeddings: DataFrame | None, refresh_volatile: bool, changes_only: bool
) -> DataFrame:
    """The target's rows after the batch and the new ones, or of both those alone that the batch writes."""
    latest = last_arrivals(arrivals)
    if embeddings is not None:
        # many urls may carry the same text, adaptive execution splits such a join
        vectors = embeddings.select("source_hash", "embedding").dropDuplicates(["source_hash"])
        latest = latest.join(vectors, "source_hash", "left")
    else:
        latest = latest.withColumn("embedding", F.lit(None).cast("array<float>"))
    incoming = F.struct(*[F.col(c) for c in latest.columns if c != "source_url"])
    batch = latest.select("source_url", incoming.alias("n"))

    # Left join and anti join instead of one full outer join: a small batch is
    # broadcast and the corpus is then not shuffled at all.
    joined = target.join(batch, "source_url", "inner" if changes_only else "left")
    changed = F.coalesce(
        F.col("n").isNotNull() & ~F.col("n.source_hash").eqNullSafe(F.col("source_hash")), F.lit(False)
    )
    moved = F.lit(False)
    if refresh_volatile:
        moved = F.coalesce(F.col("n").isNotNull() & (_volatile("n.") != _volatile()), F.lit(False))

    names = set(latest.columns)
    kept = {"grant_id", "created_at", "deleted_at", "source_url"}
    volatile = {"status", "deadline", "funding_min_eur", "funding_max_eur"}
    merged = []
    for f in CORPUS.fields:
        old = F.col(f.name)
        if f.name in kept:
            merged.append(old)
        elif f.name == "updated_at":
            merged.append(F.when(changed | moved, now).otherwise(old).alias(f.name))
        elif f.name not in names:
            merged.append(old)
        else:
            new = F.col(f"n.{f.name}").cast(f.dataType)
            if f.name in ("sector", "federal_state"):
                new = F.coalesce(new, old)
            elif f.name == "eligibility":
                new = F.when(_has_eligibility(new), new).otherwise(old)
            elif f.name == "metadata":
                new = F.when(F.size(F.coalesce(new, F.create_map().cast("map<string,string>"))) > 0, new).otherwise(old)
            when = changed | moved if f.name in volatile else changed
            merged.append(F.when(when, new).otherwise(old).alias(f.name))
    known = (joined.filter(changed | moved) if changes_only else joined).select(*merged)

    fresh = latest.join(target.select("source_url"), "source_url", "left_anti")
    added = []
    for f in CORPUS.fields:
        if f.name == "grant_id":
            # deterministic, so a retried task writes the same id
            value = F.sha2("source_url", 256)
        elif f.name in ("created_at", "updated_at"):
            value = now
        elif f.name == "deleted_at" or f.name not in names | {"source_url"}:
            value = F.lit(None)
        else:
            value = F.col(f.name)
        if f.name == "status":
            value = F.coalesce(value, F.lit("open"))
        elif f.name == "country":
            value = F.coalesce(value, F.lit("DE"))
        added.append(value.cast(f.dataType).alias(f.name))
    return known.unionByName(fresh.select(*added))


def upsert_snapshot(
    target: DataFrame,
    arrivals: DataFrame,
    now: Column,
    embeddings: DataFrame | None = None,
    refresh_volatile: bool = False,
) -> DataFrame:
    """Next snapshot: every target row, changed where the hash changed, plus new urls.

    `embeddings` (source_hash, embedding) supplies vectors for changed text;
    without one the vector is null until the backfill. Ids, created_at and
    deleted_at stay; enriched sector, state, eligibility and metadata survive empty
    incoming values. With `refresh_volatile`, a change of status, deadline or
    amounts alone updates those columns and keeps the vector.
    """
    return _upserted(target, arrivals, now, embeddings, refresh_volatile, changes_only=False)


def upsert_changes(
    target: DataFrame,
    arrivals: DataFrame,
    now: Column,
    embeddings: DataFrame | None = None,
    refresh_volatile: bool = False,
) -> DataFrame:
    """The rows of `upsert_snapshot` that differ from the target or are new: what a batch has to write.

    `target` may be cut to the rows of the arrivals' urls.
    """
    return _upserted(target, arrivals, now, embeddings, refresh_volatile, changes_only=True)


def run_counters(outcomes: DataFrame) -> DataFrame:
    """Counts of `action` per (run_id, portal)."""

    def n(action: str) -> Column:
        return F.count_if(F.col("action") == action)

    return outcomes.groupBy("run_id", "portal").agg(
        n(INSERTED).alias("inserted"),
        n(UPDATED).alias("updated"),
        n(SKIPPED).alias("skipped_unchanged"),
        n(FAILED).alias("failed"),
    )


def run_status(inserted: Column, updated: Column, failed: Column, error: Column | None = None) -> Column:
    wrote = (inserted + updated) > 0
    rules = F.when((failed > 0) & wrote, "partial").when(failed > 0, "failed").otherwise("success")
    return rules if error is None else F.when(error.isNotNull(), "failed").otherwise(rules)


def with_run_status(counters: DataFrame) -> DataFrame:
    error = F.col("error") if "error" in counters.columns else None
    return counters.withColumn("status", run_status(F.col("inserted"), F.col("updated"), F.col("failed"), error))


def run_history(ledger: DataFrame, portal: str | None = None, limit: int = 50) -> DataFrame:
    """Newest runs first, 1 to 500 of them; another limit raises ValueError."""
    if not 1 <= limit <= 500:
        raise ValueError(f"limit must be 1 to 500, not {limit}")
    runs = ledger if portal is None else ledger.filter(F.col("portal") == portal)
    return runs.orderBy(F.desc("started_at"), F.col("run_id")).limit(limit)
