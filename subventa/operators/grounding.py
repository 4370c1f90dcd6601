"""Clean-up of model replies: parsing, grounding, retries and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subventa.functions.labels import clamp_score, fit_label, severity
from subventa.functions.text import strip_fences
from subventa.functions.variants import kind_of, no_record_list, no_text, no_text_list
from subventa.schema import (
    CRITIC,
    FINDING_TYPES,
    PLANNER,
    PORTALS,
    SCORER,
    SECTORS,
    STAGES,
    WRITER,
)

# Writer runs per request at most and fallback size (fixed values).
MAX_ATTEMPTS = 2
FALLBACK_SIZE = 3

# Texts of the fixed records (fixed values).
EMPTY_SUMMARY = (
    "No grants matched your question with strong confidence. "
    "Try a more specific query, or broaden the geography / sector."
)
FALLBACK_RATIONALE = (
    "Retrieved as a strong semantic match; the Writer model was "
    "unavailable so this recommendation comes from the retrieval "
    "pipeline only — verify fit manually."
)
FALLBACK_CAVEAT = "Writer agent fallback: rationale was not LLM-generated."


def _over(column: Column, limit: int) -> Column:
    return F.coalesce(F.length(column) > limit, F.lit(False))


def _strange(column: Column, allowed: tuple[str, ...], required: bool) -> Column:
    bad = ~column.isin(*allowed)
    return F.coalesce(bad, F.lit(required))


def _planner_broken(r: Column) -> Column:
    facts = r["facts"]
    return (
        F.coalesce(F.length(r["rewritten_query"]) < 1, F.lit(True))
        | _strange(facts["sector"], SECTORS, False)
        | _strange(facts["stage"], STAGES, False)
        | F.coalesce(F.length(facts["country"]) != 2, F.lit(False))
        | _over(facts["federal_state"], 64)
        | F.coalesce(facts["funding_target_eur"] < 0, F.lit(False))
    )


def _scorer_broken(r: Column) -> Column:
    def bad(s: Column) -> Column:
        long_list = F.lit(False)
        for name in ("strengths", "concerns", "missing_info"):
            long_list = long_list | F.coalesce(F.size(s[name]) > 5, F.lit(False))
        return s["grant_id"].isNull() | long_list

    return F.coalesce(F.exists(r["scores"], bad), F.lit(False))


def _critic_broken(r: Column) -> Column:
    def bad(f: Column) -> Column:
        return _strange(f["type"], FINDING_TYPES, True) | f["message"].isNull() | _over(f["message"], 500)

    return (
        r["overall_pass"].isNull()
        | _over(r["summary"], 400)
        | F.coalesce(F.size(r["findings"]) > 10, F.lit(False))
        | F.coalesce(F.exists(r["findings"], bad), F.lit(False))
    )


def _writer_broken(r: Column) -> Column:
    def bad(x: Column) -> Column:
        missing = x["grant_id"].isNull() | x["grant_title"].isNull() | x["source_url"].isNull() | x["rationale"].isNull()
        labels = _strange(x["portal"], PORTALS, True) | _strange(x["fit"], ("high", "medium", "low"), True)
        return missing | labels | _over(x["rationale"], 1200)

    return (
        r["summary"].isNull() | _over(r["summary"], 600) | F.coalesce(F.exists(r["recommendations"], bad), F.lit(False))
    )


def _planner_kinds(d: Column) -> Column:
    facts = kind_of(d, "$.facts")
    out = no_text(d, "$.rewritten_query", required=True) | no_text(d, "$.rationale") | F.coalesce(~facts.startswith("OBJECT"), F.lit(False))
    for name in ("sector", "stage", "country", "federal_state"):
        out = out | no_text(d, f"$.facts.{name}", nullable=True)
    target = kind_of(d, "$.facts.funding_target_eur")
    return out | F.coalesce(~target.rlike("^(BIGINT|VOID|DOUBLE|DECIMAL.*)$"), F.lit(False))


def _scorer_kinds(d: Column) -> Column:
    def bad(s: Column) -> Column:
        lists = F.lit(False)
        for name in ("strengths", "concerns", "missing_info"):
            lists = lists | no_text_list(s, f"$.{name}")
        # Both labels are normalised whatever they hold, but they must be there.
        return no_text(s, "$.grant_id", required=True) | kind_of(s, "$.eligibility_score").isNull() | kind_of(s, "$.fit_label").isNull() | lists

    return no_record_list(d, "$.scores", bad)


def _critic_kinds(d: Column) -> Column:
    def bad(f: Column) -> Column:
        return (
            no_text(f, "$.type", required=True) | kind_of(f, "$.severity").isNull() | no_text(f, "$.grant_id", nullable=True) | no_text(f, "$.message", required=True)
        )

    return no_text(d, "$.summary") | no_record_list(d, "$.findings", bad)


def _writer_kinds(d: Column) -> Column:
    def bad(r: Column) -> Column:
        out = no_text_list(r, "$.caveats")
        for name in ("grant_id", "grant_title", "portal", "source_url", "fit", "rationale"):
            out = out | no_text(r, f"$.{name}", required=True)
        return out

    return no_text(d, "$.summary", required=True) | no_text_list(d, "$.questions_for_user") | no_record_list(d, "$.recommendations", bad)


# Kinds of fields per stage.
_KINDS = {"planner": _planner_kinds, "scorer": _scorer_kinds, "critic": _critic_kinds, "writer": _writer_kinds}

# Record type and its limits per stage (fixed values, in the functions above).
STAGES_OF_CHAIN = {
    "planner": (PLANNER, _planner_broken),
    "scorer": (SCORER, _scorer_broken),
    "critic": (CRITIC, _critic_broken),
    "writer": (WRITER, _writer_broken),
}


def parse_stage_replies(replies: DataFrame, stage: str, out: str = "parsed") -> DataFrame:
    """Adds the stage's record and `failed` for a reply that is none, lacks a field, holds one of a wrong kind or breaks a limit."""
    schema, broken = STAGES_OF_CHAIN[stage]
    parsed = parse_replies(replies, schema, out)
    document = F.try_parse_json(strip_fences(F.col("reply")))
    failed = F.col("failed") | F.coalesce(_KINDS[stage](document), F.lit(True)) | F.coalesce(broken(F.col(out)), F.lit(True))
    return parsed.withColumn("failed", failed).withColumn(out, F.when(~F.col("failed"), F.col(out)))


def parse_replies(replies: DataFrame, schema: T.StructType, out: str = "parsed") -> DataFrame:
    """Adds the typed record and `failed` for a reply that holds none."""
    bare = replies.withColumn("_bare", strip_fences(F.col("reply")))
    kind = F.schema_of_variant(F.try_parse_json("_bare"))
    judged = bare.withColumn("failed", ~F.coalesce(kind.startswith("OBJECT"), F.lit(False)))
    return judged.withColumn(out, F.when(~F.col("failed"), F.from_json("_bare", schema))).drop("_bare")


def normalised_scores(scores: DataFrame) -> DataFrame:
    return scores.withColumns(
        {
            "eligibility_score": clamp_score(F.col("eligibility_score").cast("string")),
            "fit_label": fit_label(F.col("fit_label")),
        }
    )


def normalised_findings(findings: DataFrame) -> DataFrame:
    return findings.withColumn("severity", severity(F.col("severity")))


def _pairs(candidates: DataFrame) -> DataFrame:
    return candidates.select("request_id", "grant_id")


def grounded(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows whose grant is among their request's candidates."""
    return rows.join(_pairs(candidates), ["request_id", "grant_id"], "left_semi")


def ungrounded(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    return rows.join(_pairs(candidates), ["request_id", "grant_id"], "left_anti")


def grounded_findings(findings: DataFrame, candidates: DataFrame) -> DataFrame:
    """As `grounded`, but a finding without a grant always stays.

    General findings bypass the join: as null keys they would meet in one task.
    """
    general = findings.filter(F.col("grant_id").isNull())
    return grounded(findings.filter(F.col("grant_id").isNotNull()), candidates).unionByName(
        general.select(*["request_id", "grant_id"], *[c for c in findings.columns if c not in ("request_id", "grant_id")])
    )


def dropped_counts(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """(request_id, total, dropped) of the grounding rule."""
    marked = rows.join(_pairs(candidates).distinct().withColumn("_in", F.lit(True)), ["request_id", "grant_id"], "left")
    return marked.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("_in").isNull()).alias("dropped")
    )


def should_retry(overall_pass: Column, attempts: Column) -> Column:
    return ~F.coalesce(overall_pass, F.lit(True)) & (F.coalesce(attempts, F.lit(1)) < MAX_ATTEMPTS)


def fallback_recommendations(requests: DataFrame, answered: DataFrame, candidates: DataFrame) -> DataFrame:
    """Top candidates as medium fits for requests without a valid answer.

    `requests` carries request_id and error; candidates carry rank (0-based).
    """
    open_requests = requests.join(answered.select("request_id"), "request_id", "left_anti")
    top = candidates.filter(F.col("rank") < FALLBACK_SIZE)
    named = [c for c in ("title", "portal", "source_url") if c in candidates.columns]
    return top.join(open_requests.select("request_id", "error"), "request_id").select(
        "request_id",
        "grant_id",
        "rank",
        *[F.col(c).alias("grant_title") if c == "title" else F.col(c) for c in named],
        F.lit("medium").alias("fit"),
        F.lit(FALLBACK_RATIONALE).alias("rationale"),
        F.array(F.lit(FALLBACK_CAVEAT)).alias("caveats"),
        fallback_summary(F.col("error")).alias("summary"),
    )


def fallback_summary(error: Column) -> Column:
    return F.concat(
        F.lit("Writer model unavailable ("),
        F.left(error, F.lit(120)),
        F.lit("). Returning the top retrieval matches without LLM-curated rationale."),
    )


def empty_answers(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """Fixed record for requests that have no candidate at all."""
    bare = requests.join(candidates.select("request_id"), "request_id", "left_anti")
    return bare.select("request_id", F.lit(EMPTY_SUMMARY).alias("summary"), F.lit(0).cast("bigint").alias("recommendations"))
