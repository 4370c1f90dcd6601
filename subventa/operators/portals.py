"""Extraction rules, one row per portal."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BASE = ("script", "style", "nav", "footer", "header")


@dataclass(frozen=True)
class PortalRule:
    portal: str
    country: str
    federal_state: str | None
    # (tag, class, inside <main>) in priority order
    headings: tuple[tuple[str, str | None, bool], ...]
    title_first: bool
    title_suffixes: tuple[str, ...]
    suffix_ignores_case: bool
    placeholder: str
    meta_first: bool
    min_summary: int
    blocked: tuple[str, ...]
    article_scope: bool
    cues: tuple[str, ...]
    window: int
    ignore_case: bool
    floor: int | None
    keeps_min: bool
    id_suffix: str
    numeric_parent_id: bool = False
    title_prefix: str | None = None
    skipped_heading: str | None = None
    boilerplate: tuple[str, ...] = field(default=())
    deadline_cues: tuple[str, ...] = field(default=())
    around_cue: int = 0


# Portal rules (fixed values).
RULES = (
    PortalRule(
        portal="exist", country="DE", federal_state=None,
        headings=(("h1", "wp-block-heading", False), ("h1", None, True), ("h1", None, False), ("*", "title-headline", False)),
        title_first=False, title_suffixes=(" - exist", " | exist", " — exist"), suffix_ignores_case=True,
        placeholder="EXIST program (title unavailable)",
        meta_first=False, min_summary=40, blocked=_BASE, article_scope=False,
        cues=("€", "EUR"), window=40, ignore_case=False, floor=None, keeps_min=True, id_suffix=".html",
        deadline_cues=("Stichtag", "Antragsfrist", "Frist", "Bewerbungsschluss", "Deadline"), around_cue=40,
    ),
    PortalRule(
        portal="kfw", country="DE", federal_state=None,
        headings=(("h1", "product-header-content", False), ("h1", None, True), ("h1", None, False)),
        title_first=False, title_suffixes=(" | KfW",), suffix_ignores_case=False,
        placeholder="KfW product (title unavailable)",
        meta_first=False, min_summary=60, blocked=_BASE + ("form",), article_scope=False,
        cues=("bis zu", "Höchstbetrag", "Kreditbetrag", "Kredithöhe"), window=80, ignore_case=False,
        floor=1_000, keeps_min=False, id_suffix="",
        title_prefix=r"(?iU)^(?:Kredit|Programm|Förderprogramm|Zuschuss)\s*Nr\.?\s*\d+(?:\s*[-–—,]\s*\d+)*\s*[-–—]?\s*",
        skipped_heading="seite teilen",
        boilerplate=("wenigen klicks", "voraussetzungen für die förderung erfüllen", "find out if you qualify"),
    ),
    PortalRule(
        portal="eic", country="EU", federal_state=None,
        headings=(("h1", "ecl-page-header__title", False), ("h1", None, True), ("h1", None, False)),
        title_first=False,
        title_suffixes=(
            " - European Innovation Council - European Commission",
            " - European Innovation Council",
            " - European Commission",
        ),
        suffix_ignores_case=False, placeholder="EIC programme (title unavailable)",
        meta_first=False, min_summary=50, blocked=_BASE + ("form", "noscript"), article_scope=True,
        cues=("up to", "below", "maximum", "lump sum", "grant component"), window=80, ignore_case=True,
        floor=100_000, keeps_min=True, id_suffix="_en",
    ),
    PortalRule(
        portal="horizon", country="EU", federal_state=None,
        headings=(("h1", "ecl-page-header__title", False), ("h1", None, True), ("h1", None, False)),
        title_first=False,
        title_suffixes=(" - Research and innovation - European Commission", " - European Commission"),
        suffix_ignores_case=False, placeholder="Horizon Europe programme (title unavailable)",
        meta_first=True, min_summary=50, blocked=_BASE + ("form", "noscript"), article_scope=False,
        cues=("up to", "below", "maximum", "lump sum"), window=80, ignore_case=True,
        floor=100_000, keeps_min=False, id_suffix="_en",
    ),
    PortalRule(
        portal="nrw", country="DE", federal_state="Nordrhein-Westfalen",
        headings=(("h1", "text-break", False), ("h1", None, True), ("h1", None, False)),
        title_first=False, title_suffixes=(" - NRW.BANK",), suffix_ignores_case=False,
        placeholder="NRW.BANK product (title unavailable)",
        meta_first=True, min_summary=60, blocked=_BASE + ("form", "noscript"), article_scope=False,
        cues=("Förderhöhe", "Förderbetrag", "Kreditbetrag", "bis zu", "maximal"), window=100, ignore_case=False,
        floor=1_000, keeps_min=False, id_suffix=".html", numeric_parent_id=True,
    ),
    PortalRule(
        portal="bw", country="DE", federal_state="Baden-Württemberg",
        headings=(
            ("h1", "m-heading-composition__headline", False), ("h1", "a-heading--main-small", False),
            ("h1", None, True), ("h1", None, False),
        ),
        title_first=False, title_suffixes=(" | L-Bank",), suffix_ignores_case=False,
        placeholder="L-Bank product (title unavailable)",
        meta_first=True, min_summary=60, blocked=_BASE + ("form", "noscript"), article_scope=False,
        cues=("bis zu", "maximal", "Förderhöhe", "Höchstbetrag", "Kredithöhe"), window=100, ignore_case=False,
        floor=10_000, keeps_min=False, id_suffix=".html",
    ),
    PortalRule(
        portal="bayern", country="DE", federal_state="Bayern",
        headings=(("h1", None, False),),
        title_first=True, title_suffixes=(), suffix_ignores_case=False,
        placeholder="Bayern Kapital (title unavailable)",
        meta_first=True, min_summary=80, blocked=_BASE + ("form", "noscript"), article_scope=False,
        cues=("bis zu", "Ticketgröße", "maximal", "Beteiligung von"), window=80, ignore_case=False,
        floor=100_000, keeps_min=False, id_suffix="",
    ),
)

NO_SUMMARY = "(no summary available)"
# Characters after a deadline cue that may hold its date (fixed value).
DEADLINE_WINDOW = 200


def by_portal(portal: Column, value) -> Column:
    """CASE over the rules; `value(rule)` is a Column or a literal."""
    out = None
    for rule in RULES:
        v = value(rule)
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(portal == rule.portal, v) if out is None else out.when(portal == rule.portal, v)
    return out


_SELECTOR = pa.struct([("tag", pa.string()), ("css", pa.string()), ("in_main", pa.bool_())])
_RULE_FIELDS = pa.schema(
    [
        ("portal", pa.string()),
        ("country", pa.string()),
        ("federal_state", pa.string()),
        ("selectors", pa.list_(_SELECTOR)),
        ("title_first", pa.bool_()),
        ("suffixes", pa.list_(pa.string())),
        ("suffix_ignores_case", pa.bool_()),
        ("placeholder", pa.string()),
        ("meta_first", pa.bool_()),
        ("min_summary", pa.int32()),
        ("floor", pa.decimal128(38, 6)),
        ("keeps_min", pa.bool_()),
        ("id_suffix", pa.string()),
        ("numeric_parent_id", pa.bool_()),
        ("skipped_heading", pa.string()),
        ("boilerplate", pa.list_(pa.string())),
    ]
)


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules as a table of one row per portal, small by construction."""
    rows = []
    for r in RULES:
        row = {f.name: getattr(r, f.name, None) for f in _RULE_FIELDS}
        row["selectors"] = [{"tag": tag, "css": css, "in_main": in_main} for tag, css, in_main in r.headings]
        row["suffixes"] = list(r.title_suffixes)
        row["boilerplate"] = list(r.boilerplate)
        row["floor"] = None if r.floor is None else Decimal(r.floor)
        rows.append(row)
    return F.broadcast(spark.createDataFrame(pa.Table.from_pylist(rows, schema=_RULE_FIELDS)))
