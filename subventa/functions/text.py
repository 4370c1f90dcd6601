"""Text, money, date and id expressions. All stay JVM-side."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unicode white space as Python's re sees it: Java's (?U)\s plus U+001C..U+001F.
SPACE = r"[\s\x1c-\x1f]"
# Line ends as Python's splitlines() sees them.
LINE_BREAK = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"
SOFT_HYPHEN = "\u00ad"

AMOUNT = T.DecimalType(38, 6)

# Month spellings (fixed values).
MONTHS = {
    "januar": 1, "jan": 1,
    "februar": 2, "feb": 2,
    "märz": 3, "maerz": 3, "mrz": 3, "mar": 3,
    "april": 4, "apr": 4,
    "mai": 5,
    "juni": 6, "jun": 6,
    "juli": 7, "jul": 7,
    "august": 8, "aug": 8,
    "september": 9, "sep": 9, "sept": 9,
    "oktober": 10, "okt": 10, "oct": 10,
    "november": 11, "nov": 11,
    "dezember": 12, "dez": 12, "dec": 12,
}

# Amount number and scale words (fixed values).
AMOUNT_NUMBER = r"[\d.,]+"
AMOUNT_SCALE = r"million(?:en)?|mio\.?|mrd\.?|milliard(?:en)?|thousand|tsd\.?|k\b"


def either_case(pattern: str) -> str:
    """The pattern for texts not lower-cased yet: each letter as the class of all that lower() turns into it.

    No ignore-case flag: it would fold dotless i and long s, too, which lower() leaves alone. The Kelvin sign
    becomes k; a dotted capital I becomes two characters, so no i.
    """
    return re.sub(r"(?<!\\)[a-z]", lambda m: f"[{m[0]}{m[0].upper()}{chr(0x212A) if m[0] == 'k' else ''}]", pattern)


AMOUNT_PATTERN = f"(?U){AMOUNT_NUMBER}{SPACE}*(?:{either_case(AMOUNT_SCALE)})?"

# Numeric and long dates (fixed values).
NUMERIC_DATE = r"(?U)(\d{4})-(\d{1,2})-(\d{1,2})|(\d{1,2})[./](\d{1,2})[./](\d{4})"
LONG_DATE = r"(?U)(\d{1,2})\.?\s+([A-Za-zäöüÄÖÜ]+)\s+(\d{4})"

# Credential parameter in a logged request url (fixed values).
SECRET_PARAM = r"[?&]key=[A-Za-z0-9_\-]+"
SECRET_MASK = "?key=<redacted>"

# Embedding task names per text prefix (fixed values).
QUERY_PREFIX, PASSAGE_PREFIX = "query: ", "passage: "
QUERY_TASK, DOCUMENT_TASK = "RETRIEVAL_QUERY", "RETRIEVAL_DOCUMENT"


def normalize_whitespace(text: Column) -> Column:
    """Drop soft hyphens, collapse white space, strip; null becomes ''."""
    visible = F.replace(F.coalesce(text, F.lit("")), F.lit(SOFT_HYPHEN), F.lit(""))
    return F.trim(F.regexp_replace(visible, f"(?U){SPACE}+", " "))


def strip(text: Column) -> Column:
    """Python's str.strip(): white space of any kind off both ends."""
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def let(value: Column, body) -> Column:
    """`body(value)` with the value evaluated once, also inside a lambda."""
    return F.transform(F.array(value), body)[0]


def amount_match(text: Column) -> Column:
    """Leftmost number with its scale word, '' when there is none."""
    return F.lower(F.regexp_extract(text, AMOUNT_PATTERN, 0))


def amount_value(match: Column) -> Column:
    """Decimal value of a string cut out by `amount_match`. Reads `match` several times."""

    def plain(number: Column) -> Column:
        dot, comma = F.contains(number, F.lit(".")), F.contains(number, F.lit(","))
        without_dots = F.replace(number, F.lit("."), F.lit(""))
        return (
            F.when(dot & comma, F.replace(without_dots, F.lit(","), F.lit(".")))
            .when(comma, F.replace(number, F.lit(","), F.lit(".")))
            .when(dot & number.rlike(r"^[^.]*(\.[^.]{3})+$"), without_dots)
            .otherwise(number)
        )

    def readable(number: Column) -> Column:
        # A cast that fails costs many times this check.
        return F.when(number.rlike(r"^(?:[^.]+\.?[^.]*|\.[^.]+)$"), number)

    def has(*words: str) -> Column:
        found = F.contains(match, F.lit(words[0]))
        for word in words[1:]:
            found = found | F.contains(match, F.lit(word))
        return found

    def times(n: int) -> Column:
        return F.lit(n).cast(T.DecimalType(10, 0))

    factor = (
        F.when(has("mio", "million"), times(1_000_000))
        .when(has("mrd", "milliard"), times(1_000_000_000))
        .when(has("k", "tsd", "thousand"), times(1_000))
        .otherwise(times(1))
    )
    number = let(let(F.regexp_extract(match, rf"(?U)\A{AMOUNT_NUMBER}", 0), plain), readable)
    return F.try_multiply(number.try_cast(T.DecimalType(28, 6)), factor).cast(AMOUNT)


def parse_amount_eur(text: Column) -> Column:
    """First euro amount in a German or English phrase, null when unreadable."""
    return let(amount_match(text), amount_value)


def date_match(text: Column) -> Column:
    """Leftmost numeric date, else leftmost long date, '' when there is neither.

    A numeric hit decides: when it is no calendar date the long form is not tried.
    """

    def find(clean: Column) -> Column:
        numeric = F.nullif(F.regexp_extract(clean, NUMERIC_DATE, 0), F.lit(""))
        return F.coalesce(numeric, F.regexp_extract(clean, LONG_DATE, 0))

    return let(normalize_whitespace(text), find)


def date_value(match: Column) -> Column:
    """Midnight in the session (UTC) zone of a string cut out by `date_match`."""
    months = F.expr("map(" + ", ".join(f"'{name}', {number}" for name, number in MONTHS.items()) + ")")
    zero = F.lit(0)

    def build(p: Column) -> Column:
        first, middle, last = (F.try_element_at(p, F.lit(i)) for i in (1, 2, 3))
        iso = F.length(first) == 4
        year = F.when(iso, first).otherwise(last).try_cast("int")
        month = F.coalesce(middle.try_cast("int"), F.try_element_at(months, F.lower(middle)))
        day = F.when(iso, last).otherwise(first).try_cast("int")
        stamp = F.try_make_timestamp(year, month, day, zero, zero, zero.cast("decimal(16,6)"))
        return F.when(year >= 1, stamp)

    return F.when(match != "", let(F.split(match, r"[-./\s]+"), build))


def parse_german_date(text: Column) -> Column:
    """First date in a phrase, null when there is none or it is no calendar date."""
    return date_value(date_match(text))


def url_parts(url: Column) -> Column:
    return F.split(F.regexp_replace(url, "/+$", ""), "/")


def content_hash(
    title: Column, summary: Column, body: Column, sector: Column, country: Column, federal_state: Column
) -> Column:
    """sha256 over the text fields only; status, deadline and amounts stay out."""
    fields = (title, summary, body, sector, country, federal_state)
    return F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in fields]), 256)


def volatile_hash(status: Column, deadline: Column, funding_min: Column, funding_max: Column) -> Column:
    """Second hash for the optional refresh of fields outside `content_hash`."""
    fields = (status, deadline.cast("string"), funding_min.cast("string"), funding_max.cast("string"))
    return F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in fields]), 256)


def embedding_text(title: Column, summary: Column, body: Column) -> Column:
    return F.concat_ws("\n\n", title, summary, body)


def embedding_task(text: Column) -> Column:
    return F.when(text.startswith(QUERY_PREFIX), F.lit(QUERY_TASK)).otherwise(F.lit(DOCUMENT_TASK))


def without_task_prefix(text: Column) -> Column:
    return (
        F.when(text.startswith(QUERY_PREFIX), F.substr(text, F.lit(len(QUERY_PREFIX) + 1)))
        .when(text.startswith(PASSAGE_PREFIX), F.substr(text, F.lit(len(PASSAGE_PREFIX) + 1)))
        .otherwise(text)
    )


def embedding_key(task: Column, text: Column) -> Column:
    return F.concat_ws(":", task, F.sha2(text, 256))


def scrub_secrets(text: Column) -> Column:
    return F.regexp_replace(text, SECRET_PARAM, SECRET_MASK)


def strip_fences(text: Column) -> Column:
    """Take Markdown code fences off a model reply."""
    opened = F.regexp_replace(F.regexp_replace(strip(text), r"\A```json", ""), r"\A```", "")
    return strip(F.regexp_replace(opened, r"```\z", ""))


def hypothetical_descriptions(reply: Column) -> Column:
    """Descriptions in a reply: {"descriptions": [..]}, a bare array, or plain lines."""
    bare = strip_fences(F.coalesce(reply, F.lit("")))
    document = F.try_parse_json(bare)
    kind = F.schema_of_variant(document)
    listed = F.when(kind.startswith("OBJECT"), F.try_variant_get(document, "$.descriptions", "array<variant>")).when(
        kind.startswith("ARRAY"), F.try_variant_get(document, "$", "array<variant>")
    )
    texts = F.transform(
        F.filter(listed, lambda v: F.schema_of_variant(v) == "STRING"),
        lambda v: strip(F.try_variant_get(v, "$", "string")),
    )
    lines = F.transform(
        F.filter(F.split(bare, LINE_BREAK), lambda s: F.length(strip(s)) > 20),
        lambda s: strip(F.regexp_replace(strip(s), r"\A[-•*]+|[-•*]+\z", "")),
    )
    found = F.when(document.isNull(), lines).otherwise(F.filter(texts, lambda s: s != ""))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.coalesce(found, F.array().cast("array<string>"))
    )
