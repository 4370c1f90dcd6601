"""Page extraction and phrase parsing over pages, documents, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from subventa.functions import text as X
from subventa.operators import extract as E
from subventa.operators.bounds import spread_small
from subventa.operators.portals import RULES
from subventa.operators.scan import first_deadline, portal_amounts
from subventa.plans.registry import query, table

# The same white space for an engine whose classes are ASCII.
_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def ws_sql(expr: str) -> str:
    return f"trim(regexp_replace(replace({expr}, chr(173), ''), '{_WS}+', ' ', 'g'))"


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


@query("text_whitespace", f"SELECT doc_id, {ws_sql('text')} AS clean FROM documents")
def whitespace(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize_whitespace(F.col("text")).alias("clean"))


# --- amounts -------------------------------------------------------------------

_PHRASE_SQL = """
SELECT l_orderkey, l_partkey, l_linenumber,
  CASE l_linenumber
    WHEN 1 THEN '€ ' || translate(format('{:,.2f}', l_extendedprice), ',.', '.,')
    WHEN 2 THEN 'EUR ' || translate(format('{:,}', CAST(floor(l_extendedprice) AS BIGINT)), ',', '.')
    WHEN 3 THEN 'ca. ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ',5 Mio. €'
    WHEN 4 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || 'k EUR'
    WHEN 5 THEN format('{:,.2f}', l_extendedprice)
    WHEN 6 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' thousand EUR per ' || l_returnflag
    ELSE l_returnflag || ' Mrd. ' || l_linestatus END AS phrase
FROM lineitem
"""


def _german(price: Column, digits: int) -> Column:
    return F.translate(F.format_number(price, digits), ",.", ".,")


def _phrases(spark, sf_dir):
    n, price = F.col("l_linenumber"), F.col("l_extendedprice")
    whole = F.col("l_quantity").cast("bigint").cast("string")
    phrase = (
        F.when(n == 1, F.concat(F.lit("€ "), _german(price, 2)))
        .when(n == 2, F.concat(F.lit("EUR "), _german(F.floor(price), 0)))
        .when(n == 3, F.concat(F.lit("ca. "), whole, F.lit(",5 Mio. €")))
        .when(n == 4, F.concat(whole, F.lit("k EUR")))
        .when(n == 5, F.format_number(price, 2))
        .when(n == 6, F.concat(whole, F.lit(" thousand EUR per "), "l_returnflag"))
        .otherwise(F.concat("l_returnflag", F.lit(" Mrd. "), "l_linestatus"))
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", phrase.alias("phrase"))


def amount_sql(expr: str) -> str:
    """Amount rules once more in SQL, as a DOUBLE expression over a phrase."""
    pattern = rf"([\d.,]+){_WS}*(million(?:en)?|mio\.?|mrd\.?|milliard(?:en)?|thousand|tsd\.?|k\b)?"
    num = f"regexp_extract(lower({expr}), '{pattern}', 1)"
    scale = f"regexp_extract(lower({expr}), '{pattern}', 2)"
    return f"""(CASE WHEN contains({num}, '.') AND contains({num}, ',')
        THEN TRY_CAST(replace(replace({num}, '.', ''), ',', '.') AS DECIMAL(28,6))
      WHEN contains({num}, ',') THEN TRY_CAST(replace({num}, ',', '.') AS DECIMAL(28,6))
      WHEN regexp_full_match({num}, '[^.]*(\\.[^.][^.][^.])+') THEN TRY_CAST(replace({num}, '.', '') AS DECIMAL(28,6))
      ELSE TRY_CAST({num} AS DECIMAL(28,6)) END
      * CASE WHEN {scale} = '' THEN 1 WHEN {scale} LIKE 'mio%' OR {scale} LIKE 'million%' THEN 1000000
        WHEN {scale} LIKE 'mrd%' OR {scale} LIKE 'milliard%' THEN 1000000000 ELSE 1000 END)"""


@query(
    "text_euro_amounts",
    f"""SELECT l_orderkey, l_partkey, l_linenumber, phrase, CAST({amount_sql("phrase")} AS DOUBLE) AS amount
    FROM ({_PHRASE_SQL})""",
)
def euro_amounts(spark, sf_dir):
    return spread_small(_phrases(spark, sf_dir)).withColumn("amount", X.parse_amount_eur(F.col("phrase")).cast("double"))


# --- dates ---------------------------------------------------------------------

_MONTH_NAMES = (
    "Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember",
)
_MONTH_LIST_SQL = "[" + ", ".join(_text(m) for m in _MONTH_NAMES) + "]"

# Every priority has its own spelling; a sixth form is no date at all.
_DATE_PHRASE_SQL = f"""
SELECT o_orderkey, CASE
    WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'laufend ab dem 31. Wurst 2026'
    WHEN o_orderpriority = '1-URGENT' THEN 'Frist ' || strftime(o_orderdate, '%d.%m.%Y') || ' um 12:30'
    WHEN o_orderpriority = '2-HIGH' THEN strftime(o_orderdate, '%Y-%m-%d')
    WHEN o_orderpriority = '3-MEDIUM' THEN 'bis ' || day(o_orderdate) || '.  ' || {_MONTH_LIST_SQL}[month(o_orderdate)] || chr(10) || year(o_orderdate)
    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%d/%m/%Y') || ' oder später'
    ELSE day(o_orderdate) || '.02.' || year(o_orderdate) || ', sonst 15. März 2026' END AS phrase
FROM orders
"""


def _date_phrases(spark, sf_dir):
    d, p = F.col("o_orderdate"), F.col("o_orderpriority")
    day, year = F.dayofmonth(d).cast("string"), F.year(d).cast("string")
    name = F.element_at(F.array(*[F.lit(m) for m in _MONTH_NAMES]), F.month(d))
    phrase = (
        F.when((F.col("o_orderstatus") == "P") & (p == "5-LOW"), "laufend ab dem 31. Wurst 2026")
        .when(p == "1-URGENT", F.concat(F.lit("Frist "), F.date_format(d, "dd.MM.yyyy"), F.lit(" um 12:30")))
        .when(p == "2-HIGH", F.date_format(d, "yyyy-MM-dd"))
        .when(p == "3-MEDIUM", F.concat(F.lit("bis "), day, F.lit(".  "), name, F.lit("\n"), year))
        .when(p == "4-NOT SPECIFIED", F.concat(F.date_format(d, "dd/MM/yyyy"), F.lit(" oder später")))
        .otherwise(F.concat(day, F.lit(".02."), year, F.lit(", sonst 15. März 2026")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", phrase.alias("phrase"))


_MONTH_CASE_SQL = " ".join(f"WHEN '{k}' THEN {v}" for k, v in X.MONTHS.items())


def date_sql(expr: str) -> str:
    clean = ws_sql(expr)
    numeric = r"(\d{4})-(\d{1,2})-(\d{1,2})|(\d{1,2})[./](\d{1,2})[./](\d{4})"
    long_form = r"(\d{1,2})\.?\s+([A-Za-zäöüÄÖÜ]+)\s+(\d{4})"

    def num(i):
        return f"regexp_extract({clean}, '{numeric}', {i})"

    def word(i):
        return f"regexp_extract({clean}, '{long_form}', {i})"

    def stamp(y, m, d):
        return f"TRY_CAST({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS TIMESTAMP)"

    return f"""CASE WHEN {num(1)} <> '' THEN {stamp(num(1), num(2), num(3))}
      WHEN {num(4)} <> '' THEN {stamp(num(6), num(5), num(4))}
      WHEN {word(1)} <> '' THEN {stamp(word(3), f"CAST(CASE lower({word(2)}) {_MONTH_CASE_SQL} END AS VARCHAR)", word(1))}
      END"""


@query("text_german_dates", f"SELECT o_orderkey, phrase, {date_sql('phrase')} AS day FROM ({_DATE_PHRASE_SQL})")
def german_dates(spark, sf_dir):
    return _date_phrases(spark, sf_dir).withColumn("day", X.parse_german_date(F.col("phrase")))


# --- cue windows ---------------------------------------------------------------

# One programme page text per line item; its line number picks the portal.
_SCAN_SQL = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE l_linenumber WHEN 1 THEN 'exist' WHEN 2 THEN 'kfw' WHEN 3 THEN 'eic' WHEN 4 THEN 'horizon'
    WHEN 5 THEN 'nrw' WHEN 6 THEN 'bw' ELSE 'bayern' END AS portal,
  'Förderhöhe bis zu ' || format('{:,}', CAST(floor(l_extendedprice) AS BIGINT)) || ' Euro, maximal '
  || translate(format('{:,}', CAST(floor(l_extendedprice * l_quantity) AS BIGINT)), ',.', '.,') || ' € je Vorhaben. UP TO '
  || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' Mio. EUR, lump sum below € ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)
  || '00.000. Maximum: ' || l_returnflag || l_linestatus || ' 900k; Höchstbetrag ' || CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR)
  || ' EUR. Beteiligung von ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ',25 Mrd. Euro bis zu bis zu ' || CAST(l_linenumber AS VARCHAR)
  || ' Tsd. €' AS scan_text
FROM lineitem
"""


def _scan_rows(spark, sf_dir):
    n, price, qty = F.col("l_linenumber"), F.col("l_extendedprice"), F.col("l_quantity")
    whole = qty.cast("bigint").cast("string")
    price_whole = F.floor(price)
    portal = (
        F.when(n == 1, "exist").when(n == 2, "kfw").when(n == 3, "eic").when(n == 4, "horizon").when(n == 5, "nrw")
        .when(n == 6, "bw").otherwise("bayern")
    )
    text = F.concat(
        F.lit("Förderhöhe bis zu "), F.format_number(price_whole, 0), F.lit(" Euro, maximal "),
        _german(F.floor(price * qty), 0), F.lit(" € je Vorhaben. UP TO "), whole,
        F.lit(" Mio. EUR, lump sum below € "), whole, F.lit("00.000. Maximum: "), "l_returnflag", "l_linestatus",
        F.lit(" 900k; Höchstbetrag "), price_whole.cast("string"), F.lit(" EUR. Beteiligung von "), whole,
        F.lit(",25 Mrd. Euro bis zu bis zu "), n.cast("string"), F.lit(" Tsd. €"),
    )
    keys = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    parts = ("l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    # The texts are made after the spreading, they are several times as long as what they are made of.
    rows = spread_small(table(spark, sf_dir, "lineitem").select(*keys, *parts))
    return rows.select(*keys, portal.alias("portal"), text.alias("scan_text"))


def _cue_values() -> str:
    rows = []
    for r in RULES:
        for cue in r.cues:
            floor = "NULL" if r.floor is None else str(r.floor)
            rows.append(
                f"({_text(r.portal)}, {_text(cue)}, {r.window}, {str(r.ignore_case).lower()}, CAST({floor} AS DECIMAL(38,6)), {r.around_cue})"
            )
    return ", ".join(rows)


def _cue_scan(portals: str) -> str:
    return f"""WITH t AS MATERIALIZED (SELECT row_number() OVER () AS rid, * FROM ({_SCAN_SQL})),
    cues(portal, cue, width, icase, floor, around) AS (VALUES {_cue_values()}),
    src AS (SELECT t.*, cue, width, floor, around, CASE WHEN icase THEN lower(scan_text) ELSE scan_text END AS s
      FROM t JOIN cues USING (portal) WHERE portal IN ({portals})),
    pos AS (SELECT *, unnest(list_filter(range(1, length(s) + 1), lambda i: s[i:i + length(cue) - 1] = cue)) AS loc FROM src),
    win AS (SELECT rid, floor,
      s[greatest(1, loc - around):CASE WHEN around > 0 THEN loc + around - 1 ELSE loc + width - 1 END] AS w FROM pos),
    amt AS (SELECT *, {amount_sql("w")} AS amount FROM win),
    agg AS (SELECT rid, CAST(min(amount) AS DOUBLE) AS lowest,
      CAST(max(amount) AS DOUBLE) AS highest, count(*) AS n FROM amt
      WHERE amount IS NOT NULL AND (floor IS NULL OR amount >= floor) GROUP BY ALL)
    SELECT t.l_orderkey, t.l_partkey, t.l_suppkey, t.l_linenumber, t.portal, agg.lowest, agg.highest, coalesce(agg.n, 0) AS n
    FROM t LEFT JOIN agg USING (rid) WHERE t.portal IN ({portals})"""


def _scanned(rows):
    amounts = portal_amounts(F.col("scan_text"), F.col("portal"), F.col("floor"))
    return E.with_rules(rows).withColumn("_a", amounts).select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "portal",
        F.array_min("_a").cast("double").alias("lowest"),
        F.array_max("_a").cast("double").alias("highest"),
        F.size("_a").cast("bigint").alias("n"),
    )


_AFTER = [r.portal for r in RULES if not r.around_cue]


@query("scan_cue_amounts", _cue_scan(", ".join(_text(p) for p in _AFTER)))
def cue_amounts(spark, sf_dir):
    """The six portals whose windows start at a cue."""
    return _scanned(_scan_rows(spark, sf_dir).filter(F.col("portal") != "exist"))


@query("scan_currency_amounts", _cue_scan("'exist'"))
def currency_amounts(spark, sf_dir):
    """The portal whose windows lie around every currency sign."""
    return _scanned(_scan_rows(spark, sf_dir).filter(F.col("portal") == "exist"))


_DEADLINE_CUES = next(r.deadline_cues for r in RULES if r.deadline_cues)

_DEADLINE_TEXT_SQL = f"""
SELECT d.o_orderkey, CASE WHEN o.o_orderstatus = 'O' THEN 'Stichtag offen. ' || repeat('Die Antragstellung ist jederzeit möglich. ', 5)
    WHEN o.o_orderstatus = 'F' THEN 'Deadline ' || strftime(o.o_orderdate, '%Y-%m-%d') || ' gilt. ' ELSE '' END
  || 'Antragsfrist: ' || d.phrase || '. Später: Antragsfrist 01.01.2030' AS scan_text
FROM ({_DATE_PHRASE_SQL}) d JOIN orders o ON o.o_orderkey = d.o_orderkey
"""


def _deadline_sql() -> str:
    per_cue = ", ".join(
        f"CASE WHEN strpos(scan_text, '{c}') > 0 THEN {date_sql(f'scan_text[strpos(scan_text, {_text(c)}):strpos(scan_text, {_text(c)}) + 199]')} END"
        for c in _DEADLINE_CUES
    )
    return f"SELECT o_orderkey, coalesce({per_cue}) AS deadline FROM ({_DEADLINE_TEXT_SQL})"


@query("scan_deadlines", _deadline_sql())
def deadlines(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    s = F.col("o_orderstatus")
    lead = (
        F.when(s == "O", F.concat(F.lit("Stichtag offen. "), F.repeat(F.lit("Die Antragstellung ist jederzeit möglich. "), 5)))
        .when(s == "F", F.concat(F.lit("Deadline "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" gilt. ")))
        .otherwise("")
    )
    text = F.concat(lead, F.lit("Antragsfrist: "), "phrase", F.lit(". Später: Antragsfrist 01.01.2030"))
    rows = _date_phrases(spark, sf_dir).join(orders, "o_orderkey").withColumn("scan_text", text)
    return rows.select("o_orderkey", first_deadline(F.col("scan_text"), _DEADLINE_CUES).alias("deadline"))


# --- pages ---------------------------------------------------------------------

# Host and language of a page decide its portal; other pages have none.
_PORTAL_SQL = """CASE WHEN url LIKE '%spam-farm%' THEN 'bmbf' WHEN url LIKE '%/de/%' AND url LIKE 'https:%' THEN 'kfw' WHEN url LIKE '%/de/%' THEN 'bayern'
  WHEN url LIKE '%/fr/%' THEN 'exist' WHEN url LIKE '%/es/%' THEN 'nrw'
  WHEN url LIKE '%example.com/en/%' THEN 'eic' WHEN url LIKE '%example.net/en/%' THEN 'horizon'
  WHEN url LIKE '%example.org/en/%' THEN 'bw' ELSE 'bmbf' END"""


def page_portal(url: Column) -> Column:
    return (
        F.when(url.like("%spam-farm%"), "bmbf")
        .when(url.like("%/de/%") & url.like("https:%"), "kfw")
        .when(url.like("%/de/%"), "bayern")
        .when(url.like("%/fr/%"), "exist")
        .when(url.like("%/es/%"), "nrw")
        .when(url.like("%example.com/en/%"), "eic")
        .when(url.like("%example.net/en/%"), "horizon")
        .when(url.like("%example.org/en/%"), "bw")
        .otherwise("bmbf")
    )


def portal_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").withColumn("portal", page_portal(F.col("url")))


_RULE_SQL = "(VALUES " + ", ".join(
    f"({_text(r.portal)}, {_text(r.country)}, CAST({_text(r.federal_state)} AS VARCHAR), {_text(r.id_suffix)}, {str(r.numeric_parent_id).lower()}, "
    f"{r.min_summary}, {str(r.title_first).lower()}, {_text(r.placeholder)})"
    for r in RULES
) + ") AS r(portal, country, federal_state, id_suffix, numeric_parent, min_summary, title_first, placeholder)"

# HTML reads an ampersand entity without its semicolon, too.
_ENTITIES_SQL = "regexp_replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')"


def _plain_sql(expr: str) -> str:
    return ws_sql(_ENTITIES_SQL.format(f"regexp_replace({expr}, '<[^>]*>', '', 'g')"))


@query(
    "page_titles",
    f"""SELECT page_id, p.portal, CASE WHEN title_first THEN {_plain_sql("regexp_extract(html, '<title>(.*?)</title>', 1)")}
      ELSE {_plain_sql("regexp_extract(html, '<h1>(.*?)</h1>', 1)")} END AS title
    FROM (SELECT *, {_PORTAL_SQL} AS portal FROM pages) p JOIN {_RULE_SQL} ON r.portal = p.portal""",
)
def page_titles(spark, sf_dir):
    records = E.extract_records(portal_pages(spark, sf_dir))
    return records.filter(F.col("parse_error").isNull()).select("page_id", "portal", "title")


@query(
    "page_summaries",
    f"""WITH p AS (SELECT page_id, min_summary, portal, html FROM (SELECT *, {_PORTAL_SQL} AS portal FROM pages) JOIN {_RULE_SQL} USING (portal)),
    parts AS (SELECT page_id, min_summary, portal,
        list_transform(string_split(html, '<p>')[2:], lambda x: {_plain_sql("regexp_replace(x, '(?s)(</p>|</article>).*', '')")}) AS ps FROM p)
    SELECT page_id, portal, coalesce(list_filter(ps, lambda x: length(x) >= min_summary)[1], '(no summary available)') AS summary FROM parts""",
)
def page_summaries(spark, sf_dir):
    records = E.extract_records(portal_pages(spark, sf_dir))
    return records.filter(F.col("parse_error").isNull()).select("page_id", "portal", "summary")


_BODY_SQL = ws_sql(
    _ENTITIES_SQL.format(
        "regexp_replace(regexp_replace(regexp_replace(CASE WHEN portal = 'eic' THEN regexp_extract(html, '(?s)<article>(.*)</article>', 1) "
        "ELSE regexp_extract(html, '(?s)<body>(.*)', 1) END, "
        "'(?s)<!--.*?-->', ' ', 'g'), '(?s)<nav>.*?</nav>|<footer>.*?</footer>|<script>.*?</script>|<style>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    )
)


@query(
    "page_bodies",
    f"SELECT page_id, portal, {_BODY_SQL} AS body FROM (SELECT *, {_PORTAL_SQL} AS portal FROM pages) WHERE portal <> 'bmbf'",
)
def page_bodies(spark, sf_dir):
    records = E.extract_records(portal_pages(spark, sf_dir))
    return records.filter(F.col("parse_error").isNull()).select("page_id", "portal", "body")


_TAIL_SQL = "string_split(rtrim(url, '/'), '/')[-1]"


@query(
    "page_doc_ids",
    f"""SELECT page_id, p.portal, CASE WHEN numeric_parent AND regexp_full_match(string_split(rtrim(url, '/'), '/')[-2], '[0-9]+')
        THEN string_split(rtrim(url, '/'), '/')[-2]
      WHEN id_suffix <> '' AND ends_with({_TAIL_SQL}, id_suffix) THEN {_TAIL_SQL}[:length({_TAIL_SQL}) - length(id_suffix)]
      ELSE {_TAIL_SQL} END AS source_doc_id
    FROM (SELECT *, {_PORTAL_SQL} AS portal FROM pages) p JOIN {_RULE_SQL} ON r.portal = p.portal""",
)
def page_doc_ids(spark, sf_dir):
    rows = portal_pages(spark, sf_dir)
    known = E.with_rules(rows).filter(F.col("country").isNotNull())
    return known.select("page_id", "portal", E.doc_id(F.col("url")).alias("source_doc_id"))


@query(
    "page_portal_constants",
    f"""SELECT page_id, p.portal, r.country, r.federal_state, CASE WHEN p.portal = 'exist' THEN 'rolling' ELSE 'open' END AS status
    FROM (SELECT *, {_PORTAL_SQL} AS portal FROM pages) p JOIN {_RULE_SQL} ON r.portal = p.portal""",
)
def page_constants(spark, sf_dir):
    records = E.extract_records(portal_pages(spark, sf_dir))
    return records.filter(F.col("parse_error").isNull()).select("page_id", "portal", "country", "federal_state", "status")


@query(
    "page_dispatch",
    f"""SELECT portal, CASE WHEN portal = 'bmbf' THEN 'unknown portal: bmbf' END AS error, count(*) AS n
    FROM (SELECT *, {_PORTAL_SQL} AS portal FROM pages) GROUP BY portal""",
)
def page_dispatch(spark, sf_dir):
    """The rule table alone decides; no page is parsed."""
    routed = E.with_rules(portal_pages(spark, sf_dir).select("portal"))
    return routed.groupBy("portal", E.dispatch_error(F.col("country"), F.col("portal")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query("page_records")
def page_records(spark, sf_dir):
    """Whole records with amounts and deadline, valid or not."""
    checked = E.with_rejections(E.extract_records(portal_pages(spark, sf_dir)))
    return checked.withColumn("reasons", F.array_join("reasons", "; "))


# --- record rules and hashes -----------------------------------------------------

# Documents as records; long first lines and odd sources break rules.
RECORDS_SQL = """
SELECT doc_id, lang AS lang, CASE source WHEN 'src0' THEN 'kfw' WHEN 'src1' THEN 'exist' WHEN 'src2' THEN 'eic' WHEN 'src3' THEN 'news'
    ELSE 'nrw' END AS portal,
  'https://corpus.example/' || source || '/' || doc_id AS source_url, 'doc-' || doc_id AS source_doc_id,
  string_split(text, chr(10))[1] AS title, text AS summary, text AS body,
  CASE lang WHEN 'es' THEN 'paused' WHEN 'de' THEN 'rolling' ELSE 'open' END AS status,
  CASE lang WHEN 'en' THEN 'saas' WHEN 'de' THEN 'deeptech' END AS sector,
  CASE lang WHEN 'fr' THEN 'FRA' ELSE upper(lang) END AS country,
  CASE lang WHEN 'de' THEN 'Bayern' END AS federal_state,
  CAST(n_chars - 100 AS DECIMAL(38,6)) AS funding_min_eur, CAST(n_chars * 100000000 AS DECIMAL(38,6)) AS funding_max_eur
FROM documents
"""


def records(spark, sf_dir):
    source, lang, key = F.col("source"), F.col("lang"), F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        F.when(source == "src0", "kfw").when(source == "src1", "exist").when(source == "src2", "eic")
        .when(source == "src3", "news").otherwise("nrw").alias("portal"),
        F.concat(F.lit("https://corpus.example/"), source, F.lit("/"), key).alias("source_url"),
        F.concat(F.lit("doc-"), key).alias("source_doc_id"),
        F.split("text", "\n")[0].alias("title"),
        F.col("text").alias("summary"),
        F.col("text").alias("body"),
        F.when(lang == "es", "paused").when(lang == "de", "rolling").otherwise("open").alias("status"),
        F.when(lang == "en", "saas").when(lang == "de", "deeptech").alias("sector"),
        F.when(lang == "fr", "FRA").otherwise(F.upper(lang)).alias("country"),
        F.when(lang == "de", "Bayern").alias("federal_state"),
        (F.col("n_chars") - 100).cast("decimal(38,6)").alias("funding_min_eur"),
        (F.col("n_chars") * 100000000).cast("decimal(38,6)").alias("funding_max_eur"),
    )


@query(
    "record_validation",
    f"""SELECT doc_id, concat_ws('; ',
      CASE WHEN length(title) < 1 THEN 'title shorter than 1' END,
      CASE WHEN length(title) > 500 THEN 'title longer than 500' END,
      CASE WHEN portal = 'news' THEN 'portal not allowed' END,
      CASE WHEN status = 'paused' THEN 'status not allowed' END,
      CASE WHEN length(country) <> 2 THEN 'country not two letters' END,
      CASE WHEN funding_min_eur < 0 THEN 'funding_min_eur negative' END,
      CASE WHEN funding_max_eur >= 999999999999.995 THEN 'funding_max_eur too large' END) AS reasons
    FROM ({RECORDS_SQL})""",
)
def record_validation(spark, sf_dir):
    return E.with_rejections(records(spark, sf_dir)).select("doc_id", F.array_join("reasons", "; ").alias("reasons"))


HASH_SQL = "sha256(title || '|' || summary || '|' || body || '|' || coalesce(sector, '') || '|' || country || '|' || coalesce(federal_state, ''))"


@query("record_content_hash", f"SELECT doc_id, {HASH_SQL} AS source_hash FROM ({RECORDS_SQL})")
def content_hash(spark, sf_dir):
    from subventa.operators.ingest import with_hash

    return with_hash(records(spark, sf_dir)).select("doc_id", "source_hash")


@query(
    "record_embedding_text",
    f"SELECT doc_id, title || chr(10) || chr(10) || summary || chr(10) || chr(10) || body AS passage FROM ({RECORDS_SQL})",
)
def embedding_text(spark, sf_dir):
    return records(spark, sf_dir).select(
        "doc_id", X.embedding_text(F.col("title"), F.col("summary"), F.col("body")).alias("passage")
    )


