"""Amounts and deadlines next to cue phrases, as projections without a shuffle."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from subventa.functions.text import amount_match, amount_value, date_match, date_value
from subventa.operators.portals import DEADLINE_WINDOW, PortalRule, by_portal


def windows_after(text: Column, cues: tuple[str, ...], width: int, ignore_case: bool = False) -> Column:
    """Every `width`-character window that starts at an occurrence of a cue."""
    source = F.lower(text) if ignore_case else text
    starts = "|".join(re.escape(c) if not c.isalpha() else c for c in cues)
    # Most places are passed over by their character alone.
    first = "".join(re.escape(c) for c in sorted({c[0] for c in cues}))
    return F.regexp_extract_all(source, F.lit(rf"(?s)(?=[{first}])(?=(?:{starts}))(?=(.{{1,{width}}}))"), F.lit(1))


def windows_around(text: Column, cue: str, reach: int) -> Column:
    """The characters from `reach` before each cue to `reach` after its start.

    Both sides come from one literal search each: the left contexts from the
    reversed text, so the cost stays linear in the text.
    """
    after = F.regexp_extract_all(
        text, F.lit(rf"(?s){re.escape(cue)}(?=(.{{0,{reach - len(cue)}}}))"), F.lit(1)
    )
    before = F.regexp_extract_all(
        F.reverse(text), F.lit(rf"(?s){re.escape(cue[::-1])}(?=(.{{0,{reach}}}))"), F.lit(1)
    )
    return F.zip_with(F.reverse(before), after, lambda b, a: F.concat(F.reverse(b), F.lit(cue), a))


def cue_windows(text: Column, rule: PortalRule) -> Column:
    if rule.around_cue:
        parts = [
            F.when(F.contains(text, F.lit(cue)), windows_around(text, cue, rule.around_cue)).otherwise(
                F.array().cast("array<string>")
            )
            for cue in rule.cues
        ]
        return F.concat(*parts)
    return windows_after(text, rule.cues, rule.window, rule.ignore_case)


def window_amounts(windows: Column) -> Column:
    """One amount per window that has a readable one."""
    matches = F.filter(F.transform(windows, amount_match), lambda m: m != "")
    return F.filter(F.transform(matches, amount_value), lambda v: v.isNotNull())


def amounts_above(amounts: Column, floor: Column) -> Column:
    return F.filter(amounts, lambda v: floor.isNull() | (v >= floor))


def portal_amounts(text: Column, portal: Column, floor: Column) -> Column:
    windows = by_portal(portal, lambda r: cue_windows(text, r))
    return amounts_above(window_amounts(windows), floor)


def first_deadline(text: Column, cues: tuple[str, ...]) -> Column:
    """Date in the window at the first occurrence of the first cue that has one."""
    windows = []
    for cue in cues:
        at = F.locate(cue, text)
        windows.append(F.when(at > 0, F.substring(text, at, F.lit(DEADLINE_WINDOW))))
    dates = F.transform(F.array_compact(F.array(*windows)), lambda w: date_value(date_match(w)))
    return F.try_element_at(F.filter(dates, lambda d: d.isNotNull()), F.lit(1))
