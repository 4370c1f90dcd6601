"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Words are runs of characters other than space, tab, line feed, vertical tab,
form feed and carriage return. The rules and their order:

* every rule is a Column that is true for a text it rejects;
* a bounded sample of rows (`SAMPLE_ROWS`, read from the first partitions that
  have them) is run once per rule: seconds spent give the cost, rejected rows
  the selectivity;
* rules run by rejected rows per second, the best first, as one CASE, so a text
  pays for no rule behind the one that rejects it.

The order changes the time and the name of the first rule met, never the verdict.

A null text counts as an empty one; it has no words and is rejected. Repeated
rows are judged one by one. Extra columns stay as they are, but `judged` replaces
those that have the name of a measure or verdict; `passing` adds and replaces none.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subventa.llm.store import free_name

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"

# Rows of the sample that costs and selectivities come from.
SAMPLE_ROWS = 256

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def words_of(text: Column) -> Column:
    """Words in order; an empty array without words."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with `value` computed once even if the optimiser moves or merges projections."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _windows(words: Column) -> Column:
    """3-word windows with their places, sorted, so that equal ones are neighbours."""
    windows = F.transform(words, lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("t"), i.alias("i")))
    return F.sort_array(F.slice(windows, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))))


def _covered(ordered: Column) -> Column:
    """Word places that repeated windows cover."""
    hits = F.filter(
        ordered,
        lambda x, j: (x["t"] == F.get(ordered, j - 1)["t"]) | (x["t"] == F.get(ordered, j + 1)["t"]),
    )
    places = F.flatten(F.transform(hits, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return F.size(F.array_distinct(places)).cast("long")


def repeated_words(words: Column) -> Column:
    """Words inside a 3-word window that the text holds twice or more."""
    return let(words, lambda w: let(_windows(w), _covered))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word)."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    own = [free_name(docs, n) for n in ("_body", "_words", "_lines")]
    b, w, ls = own
    staged = docs.withColumns({b: body, w: words_of(body), ls: lines})
    return staged.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(without(F.col(b), SPACES)).cast("long"),
            "n_symbols": (F.length(b) - F.length(without(F.col(b), SYMBOLS))).cast("long"),
            "n_dup_lines": (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"),
            "n_repeat_words": repeated_words(F.col(w)),
            "n_lines": F.size(ls).cast("long"),
        }
    ).drop(*own)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def rules(text: str = "text", known: dict[str, Column] | None = None) -> list[Rule]:
    """The rules beyond the base check; measures that are `known` already are not computed again."""
    known = known or {}
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    chars = known.get("word_chars", F.length(without(body, SPACES)))
    symbols = known.get("n_symbols", F.length(body) - F.length(without(body, SYMBOLS)))
    words = known.get("n_words", F.size(words_of(body)))
    same = known.get("n_dup_lines", F.size(lines) - F.size(F.array_distinct(lines)))
    n_lines = known.get("n_lines", F.size(lines))
    others = F.regexp_count(body, F.lit("[^\\p{L}\\x20\\x09-\\x0D]"))
    shouts = F.regexp_count(body, F.lit("\\p{Lu}"))
    bangs = F.length(body) - F.length(without(body, "!"))
    return [
        Rule("symbols", 100 * symbols > 6 * chars),
        Rule("few_letters", 100 * others > 40 * chars),
        Rule("shouting", 100 * shouts > 50 * (chars - others)),
        Rule("exclamation", 100 * bangs > 25 * words),
        Rule("word_length", (chars > 20 * words) | (chars < 2 * words)),
        Rule("same_lines", 100 * same > 60 * n_lines),
    ]


def base_rules(text: str = "text") -> list[Rule]:
    """The base check as two rules of the cascade."""
    words = words_of(F.coalesce(F.col(text), F.lit("")))
    return [Rule("few_words", F.size(words) < 50)]


def ordered_rules(sample: DataFrame, candidates: list[Rule]) -> list[tuple[Rule, int, float]]:
    """Rules with rejected sample rows and seconds, most rejections per second first; ties keep the given order."""
    sample = sample.persist()
    try:
        sample.count()
        found = []
        for rule in candidates:
            start = time.perf_counter()
            hits = sample.agg(F.count_if(rule.rejects)).first()[0]
            found.append((rule, hits, max(time.perf_counter() - start, 1e-6)))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda x: -x[1] / x[2])


def cascade(order: list[Rule]) -> Column:
    """Name of the first rule that rejects the text, null if none does."""
    out = None
    for rule in order:
        out = F.when(rule.rejects, rule.name) if out is None else out.when(rule.rejects, rule.name)
    return F.lit(None).cast("string") if out is None else out


def judged(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """`docs` with the measures, base_failed, rejected_by and kept.

    All measures are wanted here, so rules read them where they can and the
    cascade spares only what a rule computes beyond them.
    """
    known = {n: F.col(n) for n in MEASURES}
    order = [rule for rule, _, _ in ordered_rules(measured(docs.select(text).limit(sample_rows), text), rules(text, known))]
    out = measured(docs, text).withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    first = F.when(F.col("base_failed"), "base").otherwise(cascade(order))
    return out.withColumn("rejected_by", first).withColumn("kept", F.col("rejected_by").isNull())


def passing(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of `docs` that every rule lets pass, the base check included; columns as they are.

    Here a text pays for no rule behind the one that rejects it. The windows of
    the base check come last, for texts that nothing else rejects.
    """
    order = ordered_rules(docs.select(text).limit(sample_rows), base_rules(text) + rules(text))
    body = F.coalesce(F.col(text), F.lit(""))
    left = docs.filter(cascade([rule for rule, _, _ in order]).isNull())
    words = words_of(body)
    return left.filter(let(words, lambda w: ~base_failed(F.size(w), repeated_words(w))))
