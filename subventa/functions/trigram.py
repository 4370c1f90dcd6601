"""Word-padded trigrams and their set similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NON_WORD = r"[^\p{L}\p{N}]+"
# A gram inside one padded word: its middle is a word character, or it is the
# two leading blanks plus the first character. Lookahead keeps overlaps.
GRAM = r"(?=(.[^ ].|  [^ ]))"


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the whole text, each word padded '  word '."""
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NON_WORD, "   ")
    padded = F.concat(F.lit("  "), words, F.lit(" "))
    return F.array_distinct(F.regexp_extract_all(padded, F.lit(GRAM), F.lit(1)))


def set_similarity(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when(total == 0, F.lit(0.0)).otherwise(shared / total)


def similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))
