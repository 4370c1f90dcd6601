"""Statistics rollups over the lineitem corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from subventa.operators import stats as S
from subventa.plans.corpora import LINEITEM_SQL, lineitem_corpus
from subventa.plans.registry import query

_BASE = f"WITH base AS (SELECT * FROM ({LINEITEM_SQL}) WHERE deleted_at IS NULL)"


def _spread(prefix: str = "funding_") -> str:
    c = "funding_max_eur"
    return f"""CAST(min({c}) AS DOUBLE) AS {prefix}min, CAST(max({c}) AS DOUBLE) AS {prefix}max,
      round(CAST(sum({c}) AS DOUBLE) / nullif(count({c}), 0), 6) AS {prefix}avg"""


def _rounded(df, column="funding_avg"):
    return df.withColumn(column, F.round(column, 6))


@query(
    "stats_totals",
    f"""{_BASE} SELECT count(*) AS total_grants, count(embedding) AS embedded_grants, {_spread("funding_global_")} FROM base""",
)
def totals(spark, sf_dir):
    return _rounded(S.totals(lineitem_corpus(spark, sf_dir)), "funding_global_avg")


_BY_PORTAL = f"""SELECT portal, count(*) AS n, count(funding_max_eur) AS n_with_funding_max, {_spread()}
  FROM base GROUP BY portal"""


@query("stats_by_portal", f"{_BASE} {_BY_PORTAL}")
def by_portal(spark, sf_dir):
    return _rounded(S.by_portal(lineitem_corpus(spark, sf_dir)))


@query("stats_by_status", f"{_BASE} SELECT status, count(*) AS n FROM base GROUP BY status")
def by_status(spark, sf_dir):
    return S.by_status(lineitem_corpus(spark, sf_dir))


@query(
    "stats_by_state",
    f"{_BASE} SELECT federal_state, count(*) AS n FROM base WHERE federal_state IS NOT NULL GROUP BY federal_state",
)
def by_state(spark, sf_dir):
    return S.by_federal_state(lineitem_corpus(spark, sf_dir))


def _block(name: str, key: str) -> str:
    return f"""SELECT '{name}' AS block, {key} AS key, count(*) AS n, count(embedding) AS n_embedded,
      count(funding_max_eur) AS n_with_funding_max, {_spread()} FROM base"""


@query(
    "stats_rollup",
    f"""{_BASE} {_block("total", "CAST(NULL AS VARCHAR)")}
    UNION ALL {_block("portal", "portal")} GROUP BY portal
    UNION ALL {_block("status", "status")} GROUP BY status
    UNION ALL {_block("federal_state", "federal_state")} WHERE federal_state IS NOT NULL GROUP BY federal_state""",
)
def rollup(spark, sf_dir):
    return _rounded(S.rollup_blocks(lineitem_corpus(spark, sf_dir)))


@query(
    "stats_document",
    f"""{_BASE}, p AS ({_BY_PORTAL}),
    s AS (SELECT status, count(*) AS n FROM base GROUP BY status),
    f AS (SELECT federal_state, count(*) AS n FROM base WHERE federal_state IS NOT NULL GROUP BY federal_state)
    SELECT (SELECT count(*) FROM base) AS total_grants, (SELECT count(embedding) FROM base) AS embedded_grants,
      (SELECT string_agg(portal || '=' || n || '/' || n_with_funding_max || '/' || CAST(CAST(round(funding_max * 100) AS BIGINT) AS VARCHAR), ';' ORDER BY portal) FROM p) AS by_portal,
      (SELECT string_agg(status || '=' || n, ';' ORDER BY status) FROM s) AS by_status,
      (SELECT string_agg(federal_state || '=' || n, ';' ORDER BY federal_state) FROM f) AS by_federal_state""",
)
def document(spark, sf_dir):
    """The one-row document with its arrays written out as text for the comparison."""
    doc = S.statistics_document(lineitem_corpus(spark, sf_dir))

    def text(c):
        return c.cast("string")

    cents = lambda e: F.round(e["funding_max"] * 100).cast("bigint")
    return doc.select(
        "totals.total_grants",
        "totals.embedded_grants",
        F.array_join(
            F.transform(
                "by_portal",
                lambda e: F.concat(
                    e["portal"], F.lit("="), text(e["n"]), F.lit("/"), text(e["n_with_funding_max"]), F.lit("/"), text(cents(e))
                ),
            ),
            ";",
        ).alias("by_portal"),
        F.array_join(F.transform("by_status", lambda e: F.concat(e["status"], F.lit("="), text(e["n"]))), ";").alias("by_status"),
        F.array_join(
            F.transform("by_federal_state", lambda e: F.concat(e["federal_state"], F.lit("="), text(e["n"]))), ";"
        ).alias("by_federal_state"),
    )


@query(
    "stats_embedded_share",
    f"""{_BASE} SELECT count(*) AS total_grants, count(embedding) AS embedded_grants,
    CAST(floor(coalesce(count(embedding) * 100.0 / nullif(count(*), 0), 0) + 0.5) AS BIGINT) AS embedded_pct FROM base""",
)
def embedded_share(spark, sf_dir):
    return S.embedded_share(S.totals(lineitem_corpus(spark, sf_dir)))


@query(
    "stats_distribution",
    f"""{_BASE}, s AS (SELECT portal, count(*) AS n FROM base GROUP BY portal)
    SELECT portal, n, CAST(floor(CAST(n AS DOUBLE) / sum(n) OVER () * 100 + 0.5) AS BIGINT) AS pct,
      CAST(floor(CAST(n AS DOUBLE) / max(n) OVER () * 100 + 0.5) AS BIGINT) AS bar_width,
      CAST(row_number() OVER (ORDER BY n DESC, portal) AS INTEGER) AS position FROM s""",
)
def distribution(spark, sf_dir):
    return S.distribution(S.by_portal(lineitem_corpus(spark, sf_dir)).select("portal", "n"), "portal")


@query(
    "stats_rank_by_average",
    f"""{_BASE}, p AS ({_BY_PORTAL}) SELECT * FROM p WHERE funding_avg > 0 ORDER BY funding_avg DESC, portal""",
)
def rank_by_average(spark, sf_dir):
    return S.rank_by_average(_rounded(S.by_portal(lineitem_corpus(spark, sf_dir))))


@query("stats_rank_by_count", f"{_BASE}, p AS ({_BY_PORTAL}) SELECT * FROM p ORDER BY n DESC, portal")
def rank_by_count(spark, sf_dir):
    return S.rank_by_count(_rounded(S.by_portal(lineitem_corpus(spark, sf_dir))))
