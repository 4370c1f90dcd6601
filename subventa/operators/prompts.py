"""Prompt contexts per request, built as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subventa.functions.text import strip
from subventa.operators.order import top_per_key
from subventa.operators.retrieve import CANDIDATE_LIMIT

# Candidate fields per stage, in order (fixed values).
_COMMON = ("rank", "grant_id", "title", "portal")
FIELDS = {
    "scorer": _COMMON
    + ("country", "federal_state", "funding_min_eur", "funding_max_eur", "summary", "body_excerpt", "sector", "eligibility"),
    "writer": _COMMON
    + (
        "source_url", "source_doc_id", "country", "federal_state", "funding_min_eur", "funding_max_eur", "deadline",
        "summary", "body_excerpt", "sector", "eligibility",
    ),
    "critic": _COMMON + ("country", "federal_state", "summary", "body_excerpt"),
}
# Left out when a candidate has none, instead of shown as null.
_OPTIONAL = ("sector", "eligibility")
_BOOKKEEPING = ("enrichment_version", "enriched_at")

# Headings of prompt blocks (fixed values).
PROFILE_HEADINGS = {
    "planner": "Known startup profile (trust these unless the question contradicts them):",
    "critic": "Saved startup profile (use to check profile_misuse):",
}
RETRY_HEADING = (
    "You are RETRYING. A previous attempt was reviewed by the Critic and\n"
    "the following issues were flagged. Address EACH one in your output:"
)


def _json_field(name: str, candidates: DataFrame) -> Column:
    """'"name": value' text, null where an optional field is absent."""
    value = F.col(name)
    kind = candidates.schema[name].dataType
    if name == "eligibility" and isinstance(kind, T.StructType):
        value = F.when(value.isNotNull(), F.struct(*[value[f].alias(f) for f in kind.fieldNames() if f not in _BOOKKEEPING]))
    if name == "rank":
        value = value + 1
    boxed = F.to_json(F.struct(value.alias(name)), {"ignoreNullFields": "false"})
    if name == "eligibility":
        # inside an eligibility record empty fields are left out
        boxed = F.to_json(F.struct(value.alias(name)))
    inner = F.substring(boxed, F.lit(2), F.length(boxed) - 2)
    if name in _OPTIONAL:
        return F.when(value.isNotNull() & (inner != ""), inner)
    return inner


def candidates_json(candidates: DataFrame, stage: str) -> DataFrame:
    """(request_id, candidates_json): candidates in rank order, 1-based ranks.

    Prompts show the best few candidates only, which bounds the list.
    """
    candidates = candidates.filter(F.col("rank") < CANDIDATE_LIMIT)
    fields = [f for f in FIELDS[stage] if f in candidates.columns]
    record = F.concat(F.lit("{"), F.array_join(F.array(*[_json_field(f, candidates) for f in fields]), ","), F.lit("}"))
    listed = F.sort_array(F.collect_list(F.struct(F.col("rank").alias("r"), record.alias("j"))))
    return candidates.groupBy("request_id").agg(
        F.concat(F.lit("["), F.array_join(F.transform(listed, lambda x: x["j"]), ","), F.lit("]")).alias("candidates_json")
    )


# Findings of a critic record at most, and characters of a body in an enrichment prompt (fixed values).
MAX_FINDINGS = 10
EXCERPT_CHARS = 3500


def profile_block(profile: Column, fields: list[str], stage: str) -> Column:
    """Lines for the filled profile fields, '' when none is."""
    def filled_in(value: Column) -> Column:
        text = value.cast("string")
        return (text != "") & ~(F.typeof(value).startswith("array") & (text == "[]"))

    lines = [
        F.when(filled_in(profile[f]), F.concat(F.lit(f"  - {f}: "), profile[f].cast("string"))) for f in fields
    ]
    filled = F.array_compact(F.array(*lines))
    text = F.concat(F.lit(PROFILE_HEADINGS[stage] + "\n"), F.array_join(filled, "\n"), F.lit("\n\n"))
    return F.when(F.size(filled) > 0, text).otherwise(F.lit(""))


def retry_blocks(findings: DataFrame) -> DataFrame:
    """(request_id, retry_block): one line per finding, in `position` order.

    A critic record has at most ten findings, others are refused when they are parsed (grounding.parse_stage_replies).
    Of longer lists from elsewhere the first ten are shown, so one request neither ends the job nor fills a task.
    """
    grant = F.when(F.coalesce("grant_id", F.lit("")) != "", F.concat(F.lit(" (grant_id="), "grant_id", F.lit(")"))).otherwise("")
    line = F.concat(F.lit("  - ["), "severity", F.lit("] "), "type", grant, F.lit(": "), "message")
    shown = top_per_key(findings, ["request_id"], [F.col("position")], MAX_FINDINGS, rank="_nth")
    lines = F.sort_array(F.collect_list(F.struct("_nth", line.alias("line"))))
    return shown.groupBy("request_id").agg(
        F.concat(F.lit(RETRY_HEADING + "\n"), F.array_join(lines["line"], "\n"), F.lit("\n\n")).alias("retry_block")
    )


def enrichment_prompts(grants: DataFrame, template: str) -> DataFrame:
    """(grant_id, prompt) for rows with title, summary and body; the body is stripped and cut to `EXCERPT_CHARS`."""
    body = F.left(strip(F.coalesce("body", F.lit(""))), F.lit(EXCERPT_CHARS))
    variables = {
        "title": F.col("title"),
        "summary": F.coalesce("summary", F.lit("")),
        "body_excerpt": body,
        "excerpt_chars": F.lit(EXCERPT_CHARS),
    }
    return grants.select("grant_id", render(F.lit(template), variables).alias("prompt"))


def render(template: Column, variables: dict[str, Column]) -> Column:
    """Replace each {{name}}; values are inserted in the given order."""
    out = template
    for name, value in variables.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def prompt_context(
    requests: DataFrame,
    candidates: DataFrame,
    stage: str,
    template: str,
    profile_fields: list[str] | None = None,
    findings: DataFrame | None = None,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """(request_id, prompt) for one stage.

    `requests` carries request_id, query and, with `profile_fields`, a profile struct.
    """
    rows = requests.join(candidates_json(candidates, stage), "request_id", "left") if stage in FIELDS else requests
    variables = {"query": F.col("query")}
    if stage in FIELDS:
        variables["candidates_json"] = F.coalesce("candidates_json", F.lit("[]"))
    if profile_fields is not None and stage in PROFILE_HEADINGS:
        variables["profile_block"] = profile_block(F.col("profile"), profile_fields, stage)
    if findings is not None:
        rows = rows.join(retry_blocks(findings), "request_id", "left")
        variables["retry_block"] = F.coalesce("retry_block", F.lit(""))
    return rows.select("request_id", render(F.lit(template), {**(extra or {}), **variables}).alias("prompt"))
