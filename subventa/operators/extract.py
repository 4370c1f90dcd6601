"""Pages to typed records: one Arrow pass for the tags, the rest as expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subventa.functions.html import page_parts
from subventa.functions.text import let, normalize_whitespace, url_parts
from subventa.operators.bounds import spread_small
from subventa.operators.portals import NO_SUMMARY, RULES, rule_table
from subventa.operators.scan import first_deadline, portal_amounts
from subventa.schema import PORTALS, SECTORS, STATUSES

# Pages, and characters of them, whose parts are handed on at once.
WALK_ROWS, WALK_CHARS = 512, 1_000_000

_PARTS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("portal", T.StringType()),
        T.StructField("page_title", T.StringType()),
        T.StructField(
            "headings",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("tag", T.StringType()),
                        T.StructField("classes", T.ArrayType(T.StringType())),
                        T.StructField("in_main", T.BooleanType()),
                        T.StructField("text", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("paragraphs", T.ArrayType(T.StringType())),
        T.StructField("meta_description", T.StringType()),
        T.StructField("body_text", T.StringType()),
        T.StructField("scan_text", T.StringType()),
        T.StructField("parse_error", T.StringType()),
    ]
)


def page_structure(pages: DataFrame) -> DataFrame:
    """Tag walk over (page_id, url, portal, html); a bad page becomes an error row.

    The parts of some pages at a time are held as Python objects, whatever a batch holds.
    """
    scopes = {r.portal: (frozenset(r.blocked), r.article_scope) for r in RULES}

    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object) for c in _PARTS.fieldNames()})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, chars = [], 0
            for page_id, url, portal, html in batch.itertuples(index=False):
                row = dict.fromkeys(_PARTS.fieldNames()) | {"page_id": page_id, "url": url, "portal": portal}
                try:
                    row.update(page_parts(html, *scopes.get(portal, (frozenset(), False))))
                except Exception as error:  # one bad page must not end the run
                    row["parse_error"] = f"{type(error).__name__}: {error}"
                rows.append(row)
                chars += len(html or "")
                if chars >= WALK_CHARS or len(rows) >= WALK_ROWS:
                    yield frame(rows)
                    rows, chars = [], 0
            yield frame(rows)

    return spread_small(pages.select("page_id", "url", "portal", "html")).mapInPandas(walk, _PARTS)


def _headings() -> Column:
    """Usable heading text per selector, in priority order.

    A selector looks at its first element only; when that is empty the next
    selector is tried.
    """

    def first_text(s: Column) -> Column:
        def hit(h: Column) -> Column:
            return (
                ((s["tag"] == "*") | (h["tag"] == s["tag"]))
                & (s["css"].isNull() | F.array_contains(h["classes"], s["css"]))
                & (~s["in_main"] | h["in_main"])
            )

        return normalize_whitespace(F.try_element_at(F.filter("headings", hit), F.lit(1))["text"])

    skipped = F.coalesce("skipped_heading", F.lit(""))
    return F.filter(F.transform("selectors", first_text), lambda t: (t != "") & (F.lower(t) != skipped))


def _without_prefix(heading: Column) -> Column:
    out = heading
    for rule in RULES:
        if rule.title_prefix:
            cut = F.trim(F.regexp_replace(heading, rule.title_prefix, ""))
            out = F.when(F.col("portal") == rule.portal, cut).otherwise(out)
    return out


def _page_title() -> Column:
    def cut(raw: Column) -> Column:
        def ends(suffix: Column) -> Column:
            ignoring = F.endswith(F.lower(raw), F.lower(suffix))
            return F.when(F.col("suffix_ignores_case"), ignoring).otherwise(F.endswith(raw, suffix))

        suffix = F.try_element_at(F.filter("suffixes", ends), F.lit(1))
        return F.coalesce(F.trim(F.left(raw, F.length(raw) - F.length(suffix))), raw)

    return F.when(F.coalesce("page_title", F.lit("")) != "", let(normalize_whitespace(F.col("page_title")), cut))


def _title() -> Column:
    heading = _without_prefix(F.try_element_at(_headings(), F.lit(1)))
    page_title = _page_title()
    return F.when(F.col("title_first"), F.coalesce(page_title, heading, "placeholder")).otherwise(
        F.coalesce(heading, page_title, "placeholder")
    )


def _summary() -> Column:
    def usable(p: Column) -> Column:
        told = F.exists("boilerplate", lambda token: F.contains(F.lower(p), token))
        return (F.length(p) >= F.col("min_summary")) & ~told

    paragraph = F.try_element_at(F.filter(F.transform("paragraphs", normalize_whitespace), usable), F.lit(1))
    described = F.nullif(normalize_whitespace(F.col("meta_description")), F.lit(""))
    nothing = F.lit(NO_SUMMARY)
    return F.when(F.col("meta_first"), F.coalesce(described, paragraph, nothing)).otherwise(
        F.coalesce(paragraph, described, nothing)
    )


def doc_id(url: Column) -> Column:
    """Last url part without the portal's suffix, or the numeric parent part."""

    def pick(parts: Column) -> Column:
        tail, suffix = F.element_at(parts, -1), F.col("id_suffix")
        short = F.when(F.endswith(tail, suffix), F.left(tail, F.length(tail) - F.length(suffix))).otherwise(tail)
        parent = F.try_element_at(parts, F.lit(-2))
        return F.when(F.col("numeric_parent_id") & parent.rlike(r"(?U)^\d+$"), parent).otherwise(short)

    return let(url_parts(url), pick)


def with_rules(pages: DataFrame) -> DataFrame:
    """Adds the portal's rule columns; `country` is null where a portal has no rule."""
    return pages.join(rule_table(pages.sparkSession), "portal", "left")


def portal_status(portal: Column, deadline: Column) -> Column:
    return F.when(portal != "exist", F.lit("open")).when(deadline.isNull(), "rolling").otherwise("open")


def dispatch_error(country: Column, portal: Column) -> Column:
    """Error of a page whose portal has no rule, else null; `country` comes from the rule table."""
    return F.when(country.isNull(), F.concat(F.lit("unknown portal: "), F.coalesce(portal, F.lit("null"))))


def extract_records(pages: DataFrame) -> DataFrame:
    """Typed record per page; `parse_error` is set where there is none.

    Input: page_id, url, portal, html. Pages of a portal without a rule come
    out as errors, too.
    """
    portal, scan = F.col("portal"), F.col("scan_text")
    deadline = F.lit(None).cast("timestamp")
    for rule in RULES:
        if rule.deadline_cues:
            deadline = F.when(portal == rule.portal, first_deadline(scan, rule.deadline_cues)).otherwise(deadline)
    cut = with_rules(page_structure(pages)).select(
        "page_id",
        "portal",
        F.col("url").alias("source_url"),
        F.when(F.col("country").isNotNull(), doc_id(F.col("url"))).alias("source_doc_id"),
        _title().alias("title"),
        F.when(F.col("country").isNotNull(), _summary()).alias("summary"),
        normalize_whitespace(F.col("body_text")).alias("body"),
        "country",
        "federal_state",
        deadline.alias("deadline"),
        portal_amounts(scan, portal, F.col("floor")).alias("amounts"),
        "keeps_min",
        F.coalesce(dispatch_error(F.col("country"), portal), F.col("parse_error")).alias("parse_error"),
    )
    return cut.select(
        "page_id",
        "portal",
        "source_url",
        "source_doc_id",
        "title",
        "summary",
        "body",
        portal_status(portal, F.col("deadline")).alias("status"),
        "country",
        "federal_state",
        F.when(F.col("keeps_min"), F.array_min("amounts")).alias("funding_min_eur"),
        F.array_max("amounts").alias("funding_max_eur"),
        "deadline",
        "parse_error",
    )


def _too_long(column: str, limit: int) -> Column:
    return F.when(F.length(column) > limit, F.lit(f"{column} longer than {limit}"))


def _outside(column: str, allowed: tuple[str, ...], nullable: bool) -> Column:
    bad = ~F.col(column).isin(*allowed)
    if not nullable:
        bad = F.col(column).isNull() | bad
    return F.when(bad, F.lit(f"{column} not allowed"))


def rejection_reasons(columns: list[str]) -> Column:
    """Array of broken rules per record; optional columns are checked if present."""
    required = [
        F.when(F.col(c).isNull() | (F.length(c) < n), F.lit(f"{c} shorter than {n}"))
        for c, n in (("source_url", 10), ("title", 1), ("summary", 1), ("body", 1))
    ]
    limits = {"source_url": 1000, "source_doc_id": 255, "title": 500, "title_en": 500, "federal_state": 64}
    too_long = [_too_long(c, n) for c, n in limits.items() if c in columns]
    enums = [_outside("portal", PORTALS, False), _outside("status", STATUSES, False)]
    if "sector" in columns:
        enums.append(_outside("sector", SECTORS, True))
    country = F.when(F.col("country").isNull() | (F.length("country") != 2), F.lit("country not two letters"))
    money = []
    for c in ("funding_min_eur", "funding_max_eur"):
        if c in columns:
            money.append(F.when(F.col(c) < 0, F.lit(f"{c} negative")))
            money.append(F.when(F.col(c) >= F.lit("999999999999.995").cast("decimal(38,6)"), F.lit(f"{c} too large")))
    parse = [F.col("parse_error")] if "parse_error" in columns else []
    return F.array_compact(F.array(*parse, *required, *too_long, *enums, country, *money))


def with_rejections(records: DataFrame) -> DataFrame:
    return records.withColumn("reasons", rejection_reasons(records.columns))


def split_valid(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid records, rejected records with `reasons`)."""
    checked = with_rejections(records)
    valid = checked.filter(F.size("reasons") == 0).drop("reasons", "parse_error")
    return valid, checked.filter(F.size("reasons") > 0)
