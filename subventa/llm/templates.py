"""Line dedup by a log-template tree.

Lines are cut into tokens at white space; a token with a digit is a field `<*>`.
A fixed-depth tree sorts lines by their number of tokens and their first
`DEPTH` tokens. Two kinds of templates come out of it:

* the whole line with its fields generalised;
* inside a leaf of lines of `MIN_DOCS` independent documents, the fixed tokens;
  the other places are variable. A token is fixed where it has more than `SHARE`
  percent of the leaf's lines that have the same token before it, and of those
  that have the same token behind it, and `MIN_DOCS` lines hold it there. Shares
  do not depend on the size of the leaf, and neighbours tell apart templates that
  meet in one leaf. Such a template needs at least `SIMILAR` percent fixed tokens.

A template recurs when at least `MIN_DOCS` independent documents hold it. Copies
of a document are not independent: exact copies count as one text, and texts
whose smallest line is the same count as one kin. Lines are taken as they stand
here, so texts made of the same templates with other field values are no copies.
A template shared by near copies alone has few kins among many texts, so kins
must also be at least half the texts. The smallest line may be one that all
share, so there are four orders (MD5 digests, rotated), and the order with the
most kins counts. Lines of recurring templates are dropped from every document, in no other way is a text
changed.

Only hashes of lines are shuffled; leaves and templates are counted with partial
aggregation and no leaf is collected, so a line that a third of all documents
share is no hot task.

Defined cases: a null text stays null and has no lines, an empty one has one
empty line. Lines of fewer than `MIN_TOKENS` tokens are never dropped. Rows that
repeat a doc_id with the same text get the same result; rows that share a doc_id
but not the text are treated by their own lines. Extra columns stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subventa.llm.store import free_name, materialise

DEPTH = 4
MIN_DOCS = 3
MIN_TOKENS = 2
SIMILAR = 70
SHARE = 50
FIELD = "<*>"

_SPACES = " \t\n\x0b\f\r"
_SPACE_RUN = "[\\x20\\x09-\\x0D]+"
_FIELD = "[^ 0-9]*+[0-9][^ ]*+"


def generalised(lines: Column) -> Column:
    """Of every line its tokens joined by single spaces, those with a digit as fields, beside the line itself.

    Lambdas share no common parts, so each step is bound in an array of its own. Lines that need no change skip the patterns.
    """

    def step(array: Column, then: Callable[[Column], Column]) -> Column:
        return F.transform(array, lambda x: F.struct(x["line"].alias("line"), then(x["general"]).alias("general")))

    trimmed = F.transform(lines, lambda line: F.struct(line.alias("line"), F.btrim(line, F.lit(_SPACES)).alias("general")))
    spaced = step(trimmed, lambda t: F.when(F.rlike(t, F.lit("[\\x09-\\x0D]|  ")), F.regexp_replace(t, _SPACE_RUN, " ")).otherwise(t))
    return step(spaced, lambda t: F.when(F.rlike(t, F.lit("[0-9]")), F.regexp_replace(t, _FIELD, FIELD)).otherwise(t))


def token_count(general: Column) -> Column:
    return F.length(general) - F.length(F.translate(general, " ", "")) + 1


def _line_tables(docs: DataFrame, text: str, depth: int, min_tokens: int) -> tuple[DataFrame, DataFrame]:
    """Per line: row (hash of the text), place, leaf, template; and per text: row, kins. Copies are one row."""
    general = generalised(F.split(text, "\n", -1))
    sized = F.transform(general, lambda x: F.struct(x["line"].alias("line"), x["general"].alias("general"), token_count(x["general"]).alias("n")))
    staged = docs.select(text).filter(F.col(text).isNotNull()).select(
        F.xxhash64(text).alias("row"), F.transform(sized, lambda x: _parsed(x["line"], x["general"], x["n"], depth, min_tokens)).alias("lines")
    )
    names = F.transform(F.filter("lines", lambda x: x["name"].isNotNull()), lambda x: x["name"])

    def rotated(by: int) -> Column:
        return F.transform(names, lambda n: F.concat(F.substring(n, 1 + by, 32 - by), F.substring(n, 1, by)))

    turned = [rotated(by) for by in (8, 16, 24)]
    kins = F.array(*[F.xxhash64(F.array_min(t)) for t in (names, *turned)])
    small = F.transform("lines", lambda x: F.struct(x["leaf"].alias("leaf"), x["template"].alias("template")))
    both = materialise(staged.select("row", kins.alias("kins"), small.alias("lines")), "lines")
    lines = both.select("row", F.posexplode("lines").alias("place", "line")).filter("line.template is not null")
    return lines.select("row", "place", "line.leaf", "line.template"), both.select("row", "kins").distinct()


def _parsed(line: Column, general: Column, n: Column, depth: int, min_tokens: int) -> Column:
    long = n >= min_tokens
    return F.struct(
        F.xxhash64(n, F.substring_index(general, " ", depth)).alias("leaf"),
        F.when(long, F.xxhash64(F.md5(general.cast("binary")))).alias("template"),
        F.when(long, F.md5(line.cast("binary"))).alias("name"),
    )


def _often(lines: DataFrame, keys: list[str], min_docs: int) -> DataFrame:
    return lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).select(*keys)


def _independent(lines: DataFrame, kins: DataFrame, keys: list[str], min_docs: int) -> DataFrame:
    """Keys with at least `min_docs` kins, their number and that of the texts."""
    held = lines.join(_often(lines, keys, min_docs), keys, "left_semi").select(*keys, "row").distinct()
    spread = held.join(kins, "row").select(*keys, F.posexplode("kins").alias("order", "kin"))
    counted = spread.groupBy(*keys, "order", "kin").agg(F.count(F.lit(1)).alias("texts"))
    counted = counted.groupBy(*keys, "order").agg(F.count(F.lit(1)).alias("kins"), F.sum("texts").alias("texts"))
    return counted.groupBy(*keys).agg(F.max("kins").alias("n_kins"), F.max("texts").alias("n_texts")).filter(F.col("n_kins") >= min_docs)


def _recurring(lines: DataFrame, kins: DataFrame, min_docs: int) -> DataFrame:
    """Templates that enough independent documents hold."""
    return _independent(lines, kins, ["template"], min_docs).filter("2 * n_kins >= n_texts").select("template")


def _fixed(spread: DataFrame, min_docs: int, share: int = SHARE) -> DataFrame:
    """(leaf, i, before, token, behind) of fixed tokens."""
    place = ["leaf", "i"]
    seen = materialise(spread.groupBy(*place, "before", "token", "behind").agg(F.count(F.lit(1)).alias("n")), "tokens")

    def of(*keys: str) -> DataFrame:
        return seen.groupBy(*place, *keys).agg(F.sum("n").alias("n"))

    def led(side: str) -> DataFrame:
        whole = of(side).withColumnRenamed("n", "whole")
        return of(side, "token").join(whole, [*place, side]).filter(100 * F.col("n") > share * F.col("whole")).select(*place, side, "token")

    often = of("token").filter(F.col("n") >= min_docs)
    out = seen.select(*place, "before", "token", "behind")
    for keys, kept in ((["token"], often), (["before", "token"], led("before")), (["token", "behind"], led("behind"))):
        out = out.join(kept, [*place, *keys], "left_semi")
    return out


def recurring_places(docs: DataFrame, text: str = "text", depth: int = DEPTH, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, similar: int = SIMILAR) -> DataFrame:
    """(row, places): hash of a text and the places of its lines that recurring templates hold."""
    lines, kins = _line_tables(docs, text, depth, min_tokens)
    whole = materialise(_recurring(lines, kins, min_docs), "templates")
    hits = lines.join(whole, "template", "left_semi").select("row", "place")

    # Leaves with other lines of enough kins, and the tokens that are fixed there.
    open_lines = materialise(lines.join(whole, "template", "left_anti").distinct(), "open")
    leaves = _independent(open_lines, kins, ["leaf"], min_docs).select("leaf")
    wanted = open_lines.join(leaves, "leaf", "left_semi").groupBy("row").agg(F.collect_set(F.struct("place", "leaf")).alias("wanted"))
    wanted = materialise(wanted, "wanted")
    texts = docs.select(F.xxhash64(text).alias("row"), F.col(text).alias("body")).filter("body is not null").join(wanted.hint("merge"), "row")
    texts = texts.dropDuplicates(["row"]).withColumn("lines", F.split("body", "\n", -1))
    inside = texts.select("row", F.explode(F.transform("wanted", lambda x: F.struct(x["place"].alias("place"), x["leaf"].alias("leaf"), F.get(F.col("lines"), x["place"]).alias("line")))).alias("x"))
    inside = inside.select("row", "x.place", "x.leaf", F.transform(F.split(generalised(F.array("x.line"))[0]["general"], " "), lambda t: F.xxhash64(t)).alias("tokens"))
    inside = materialise(inside, "inside")
    beside = F.transform("tokens", lambda t, i: F.struct(t.alias("token"), *(F.coalesce(F.get("tokens", i + by), F.lit(0)).alias(n) for n, by in (("before", -1), ("behind", 1)))))
    spread = inside.select("row", "place", "leaf", F.size("tokens").alias("n"), F.posexplode(beside).alias("i", "x")).select("row", "place", "leaf", "n", "i", "x.*")
    fixed = _fixed(spread, min_docs)
    named = F.sum(F.xxhash64("i", "token").cast("decimal(20,0)")).cast("string")
    general = (
        spread.join(fixed, ["leaf", "i", "before", "token", "behind"])
        .groupBy("row", "place", "leaf", "n")
        .agg(F.count(F.lit(1)).alias("fixed"), named.alias("name"))
        .filter(100 * F.col("fixed") >= similar * F.col("n"))
        .select("row", "place", F.xxhash64("leaf", "name").alias("template"))
    )
    general = materialise(general, "general")
    more = general.join(_recurring(general, kins, min_docs), "template", "left_semi").select("row", "place")
    return hits.union(more).groupBy("row").agg(F.collect_set("place").alias("places"))


def without_recurring(docs: DataFrame, text: str = "text", counts: tuple[str, str] | None = None, **settings: int) -> DataFrame:
    """`docs` with recurring lines dropped from `text`; `counts` names columns for lines and dropped lines."""
    found = materialise(recurring_places(docs, text, **settings), "places")
    row, places, lines = (free_name(docs, n) for n in ("_row", "_places", "_lines"))
    found = found.select(F.col("row").alias(row), F.col("places").alias(places))
    # One join strategy at every size; adaptive execution may still split a text that many rows share.
    out = docs.withColumn(row, F.xxhash64(F.col(text))).join(found.hint("merge"), row, "left").withColumn(lines, F.split(text, "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(places))
    left = F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n")
    changed = {text: F.when(F.col(places).isNull(), F.col(text)).otherwise(left)}
    if counts:
        changed[counts[0]] = F.coalesce(F.size(lines), F.lit(0)).cast("long")
        changed[counts[1]] = F.coalesce(F.size(places), F.lit(0)).cast("long")
    return out.withColumns(changed).drop(row, places, lines)
