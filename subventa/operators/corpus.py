"""Corpus reads: live scan, filters, sorting, paging, projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EQUALITY_FILTERS = ("portal", "status", "sector", "country", "federal_state")
# Largest page (fixed value).
MAX_PAGE = 200

LIST_COLUMNS = (
    "grant_id", "portal", "status", "title", "title_en", "summary", "sector", "country", "federal_state",
    "funding_min_eur", "funding_max_eur", "deadline", "opens_at", "source_url", "source_doc_id", "created_at",
    "updated_at",
)
DETAIL_COLUMNS = LIST_COLUMNS + ("body", "summary_en", "eligibility", "metadata")
SCORE_COLUMNS = ("final_score", "dense_rank", "sparse_rank", "rrf_score", "rerank_score")


def live(corpus: DataFrame) -> DataFrame:
    return corpus.filter(F.col("deleted_at").isNull())


def filter_condition(
    min_funding: float | None = None, max_funding: float | None = None, **equals: str | None
) -> Column:
    """Conjunction of the given filters; both bounds test the ceiling."""
    unknown = set(equals) - set(EQUALITY_FILTERS)
    if unknown:
        raise ValueError(f"no such filter: {sorted(unknown)}")
    terms = []
    for name, value in equals.items():
        if value is not None:
            terms.append(F.col(name) == (value.upper() if name == "country" else value))
    if min_funding is not None:
        terms.append(F.col("funding_max_eur") >= F.lit(min_funding))
    if max_funding is not None:
        terms.append(F.col("funding_max_eur") <= F.lit(max_funding))
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def filter_corpus(corpus: DataFrame, **filters) -> DataFrame:
    return live(corpus).filter(filter_condition(**filters))


def sort_order(key: str = "created_at") -> list[Column]:
    orders = {
        "created_at": F.desc("created_at"),
        "deadline": F.asc_nulls_last("deadline"),
        "funding_max": F.desc_nulls_last("funding_max_eur"),
    }
    if key not in orders:
        raise ValueError(f"no such sort key: {key!r}")
    return [orders[key], F.col("grant_id")]


def page(rows: DataFrame, sort: str = "created_at", limit: int = 50, offset: int = 0) -> DataFrame:
    """One sorted page; Spark plans a top-k of offset + limit rows per task."""
    if offset < 0 or not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be 1..{MAX_PAGE} and offset >= 0")
    return rows.orderBy(*sort_order(sort)).offset(offset).limit(limit)


def page_meta(rows: DataFrame, limit: int, offset: int) -> DataFrame:
    total = F.count(F.lit(1))
    left = F.greatest(total - F.lit(offset), F.lit(0))
    return rows.agg(
        total.alias("total"),
        F.lit(limit).alias("limit"),
        F.lit(offset).alias("offset"),
        F.least(left, F.lit(limit)).cast("bigint").alias("returned"),
    )


def point_lookup(corpus: DataFrame, grant_id) -> DataFrame:
    return live(corpus).filter(F.col("grant_id") == grant_id)


def _project(rows: DataFrame, columns: tuple[str, ...]) -> list[Column]:
    money = ("funding_min_eur", "funding_max_eur")
    return [
        F.col(c).cast("double").alias(c) if c in money else F.col(c) for c in columns if c in rows.columns
    ]


def as_list_items(rows: DataFrame) -> DataFrame:
    return rows.select(*_project(rows, LIST_COLUMNS))


def as_details(rows: DataFrame) -> DataFrame:
    return rows.select(*_project(rows, DETAIL_COLUMNS))


def as_search_hits(rows: DataFrame) -> DataFrame:
    """List columns, scores and a citation struct."""
    cited = [c for c in ("grant_id", "source_doc_id", "source_url", "portal", "title") if c in rows.columns]
    keep = [c for c in ("qid", "rank") if c in rows.columns]
    return rows.select(
        *keep,
        *_project(rows, LIST_COLUMNS),
        *[c for c in SCORE_COLUMNS if c in rows.columns],
        F.struct(*cited).alias("citation"),
    )
