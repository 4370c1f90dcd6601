"""Corpora made of the given tables, as DataFrames and as the same SQL; corpus queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from subventa.operators import corpus as C
from subventa.operators.ingest import run_history
from subventa.operators.pages import write_pages
from subventa.operators.retrieve import fetch_live
from subventa.plans.registry import query, table
from subventa.sources.shared import shared_path

# --- lineitem as a large corpus for statistics ------------------------------

LINEITEM_SQL = """
SELECT CASE l_linenumber WHEN 1 THEN 'exist' WHEN 2 THEN 'kfw' WHEN 3 THEN 'eic' WHEN 4 THEN 'horizon'
         WHEN 5 THEN 'nrw' WHEN 6 THEN 'bw' ELSE 'bayern' END AS portal,
       CASE l_returnflag WHEN 'A' THEN 'closed' WHEN 'N' THEN 'open' ELSE 'rolling' END AS status,
       CASE l_linenumber WHEN 5 THEN 'Nordrhein-Westfalen' WHEN 6 THEN 'Baden-Württemberg'
         WHEN 7 THEN 'Bayern' END AS federal_state,
       CASE WHEN l_discount > 0 THEN CAST(l_extendedprice AS DECIMAL(14,2)) END AS funding_max_eur,
       CASE WHEN l_quantity >= 10 THEN l_quantity END AS embedding,
       CASE WHEN l_tax >= 0.075 THEN l_shipdate END AS deleted_at
FROM lineitem
"""


def lineitem_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    portal = (
        F.when(n == 1, "exist").when(n == 2, "kfw").when(n == 3, "eic").when(n == 4, "horizon").when(n == 5, "nrw")
        .when(n == 6, "bw").otherwise("bayern")
    )
    state = F.when(n == 5, "Nordrhein-Westfalen").when(n == 6, "Baden-Württemberg").when(n == 7, "Bayern")
    return table(spark, sf_dir, "lineitem").select(
        portal.alias("portal"),
        F.when(flag == "A", "closed").when(flag == "N", "open").otherwise("rolling").alias("status"),
        state.alias("federal_state"),
        F.when(F.col("l_discount") > 0, F.col("l_extendedprice").cast("decimal(14,2)")).alias("funding_max_eur"),
        F.when(F.col("l_quantity") >= 10, F.col("l_quantity")).alias("embedding"),
        F.when(F.col("l_tax") >= 0.075, F.col("l_shipdate")).alias("deleted_at"),
    )


# --- orders as a listing corpus ---------------------------------------------

ORDERS_SQL = """
SELECT o_orderkey AS grant_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'kfw' WHEN '2-HIGH' THEN 'eic' WHEN '3-MEDIUM' THEN 'exist'
         WHEN '4-NOT SPECIFIED' THEN 'nrw' ELSE 'bw' END AS portal,
       CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'rolling' END AS status,
       'Order ' || o_orderkey AS title,
       CAST(NULL AS VARCHAR) AS title_en,
       o_orderpriority || ' for customer ' || o_custkey AS summary,
       CAST(NULL AS VARCHAR) AS summary_en,
       'Status ' || o_orderstatus || ', priority ' || o_orderpriority || ', customer ' || o_custkey AS body,
       CASE WHEN o_totalprice > 300000 THEN 'deeptech' WHEN o_totalprice > 150000 THEN 'saas' END AS sector,
       CASE o_orderpriority WHEN '2-HIGH' THEN 'EU' ELSE 'DE' END AS country,
       CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'Nordrhein-Westfalen'
         WHEN '5-LOW' THEN 'Baden-Württemberg' END AS federal_state,
       CASE WHEN o_totalprice > 50000 THEN CAST(1000 AS DECIMAL(14,2)) END AS funding_min_eur,
       CASE WHEN o_totalprice > 20000 THEN CAST(o_totalprice AS DECIMAL(14,2)) END AS funding_max_eur,
       CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS deadline,
       CAST(NULL AS TIMESTAMP) AS opens_at,
       'https://portal.example/orders/' || o_orderkey AS source_url,
       'order-' || o_orderkey AS source_doc_id,
       o_orderdate AS created_at,
       o_orderdate AS updated_at,
       CASE WHEN o_totalprice > 450000 THEN o_orderdate END AS deleted_at
FROM orders
"""


def orders_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s, price = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_totalprice")
    key, customer, day = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderdate")
    day = day.cast("timestamp")
    nothing = F.lit(None)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("grant_id"),
        F.when(p == "1-URGENT", "kfw").when(p == "2-HIGH", "eic").when(p == "3-MEDIUM", "exist")
        .when(p == "4-NOT SPECIFIED", "nrw").otherwise("bw").alias("portal"),
        F.when(s == "O", "open").when(s == "F", "closed").otherwise("rolling").alias("status"),
        F.concat(F.lit("Order "), key).alias("title"),
        nothing.cast("string").alias("title_en"),
        F.concat(p, F.lit(" for customer "), customer).alias("summary"),
        nothing.cast("string").alias("summary_en"),
        F.concat(F.lit("Status "), s, F.lit(", priority "), p, F.lit(", customer "), customer).alias("body"),
        F.when(price > 300000, "deeptech").when(price > 150000, "saas").alias("sector"),
        F.when(p == "2-HIGH", "EU").otherwise("DE").alias("country"),
        F.when(p == "4-NOT SPECIFIED", "Nordrhein-Westfalen").when(p == "5-LOW", "Baden-Württemberg").alias("federal_state"),
        F.when(price > 50000, F.lit(1000).cast("decimal(14,2)")).alias("funding_min_eur"),
        F.when(price > 20000, price.cast("decimal(14,2)")).alias("funding_max_eur"),
        F.when(s != "P", day).alias("deadline"),
        nothing.cast("timestamp").alias("opens_at"),
        F.concat(F.lit("https://portal.example/orders/"), key).alias("source_url"),
        F.concat(F.lit("order-"), key).alias("source_doc_id"),
        day.alias("created_at"),
        day.alias("updated_at"),
        F.when(price > 450000, day).alias("deleted_at"),
    )


# --- documents as the searched corpus ---------------------------------------

DOCUMENTS_SQL = """
SELECT d.doc_id AS grant_id, d.source AS portal, upper(d.lang) AS country,
       string_split(d.text, chr(10))[1] AS title, d.text AS summary, d.text AS body, e.embedding AS embedding,
       CASE WHEN l.toxic = 1 THEN TIMESTAMP '2024-01-01 00:00:00' END AS deleted_at,
       'doc-' || d.doc_id AS source_doc_id, d.n_chars AS n_chars,
       e.label AS label, l.quality AS quality
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id
"""

# Queries carry a benchmark passage as text and a vector of their own.
QUERIES_SQL = """
SELECT b.item_id AS qid, b.text AS query, e.embedding AS embedding, e.label AS label
FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id
"""


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    labels = table(spark, sf_dir, "labels")
    return (
        docs.join(vectors, "doc_id", "left")
        .join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").alias("grant_id"),
            F.col("source").alias("portal"),
            F.upper("lang").alias("country"),
            F.split("text", "\n")[0].alias("title"),
            F.col("text").alias("summary"),
            F.col("text").alias("body"),
            "embedding",
            F.when(F.col("toxic") == 1, F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("deleted_at"),
            F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_doc_id"),
            "n_chars",
            "label",
            "quality",
        )
    )


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    items = table(spark, sf_dir, "benchmark")
    return items.join(vectors, items["item_id"] == vectors["vec_id"]).select(
        F.col("item_id").alias("qid"), F.col("text").alias("query"), "embedding", "label"
    )


# --- corpus queries -----------------------------------------------------------

_LIST = """grant_id, portal, status, title, title_en, summary, sector, country, federal_state,
  CAST(funding_min_eur AS DOUBLE) AS funding_min_eur, CAST(funding_max_eur AS DOUBLE) AS funding_max_eur,
  deadline, opens_at, source_url, source_doc_id, created_at, updated_at"""


@query(
    "corpus_live_scan",
    f"WITH c AS ({ORDERS_SQL}) SELECT grant_id, portal, status, created_at FROM c WHERE deleted_at IS NULL",
)
def live_scan(spark, sf_dir):
    return C.live(orders_corpus(spark, sf_dir)).select("grant_id", "portal", "status", "created_at")


@query(
    "corpus_filter_equal",
    f"""WITH c AS ({ORDERS_SQL}) SELECT {_LIST} FROM c WHERE deleted_at IS NULL AND portal = 'nrw'
    AND status = 'open' AND sector = 'saas' AND country = 'DE' AND federal_state = 'Nordrhein-Westfalen'""",
)
def filter_equal(spark, sf_dir):
    rows = C.filter_corpus(
        orders_corpus(spark, sf_dir), portal="nrw", status="open", sector="saas", country="de",
        federal_state="Nordrhein-Westfalen",
    )
    return C.as_list_items(rows)


@query(
    "corpus_filter_range",
    f"""WITH c AS ({ORDERS_SQL}) SELECT grant_id, CAST(funding_max_eur AS DOUBLE) AS funding_max_eur FROM c
    WHERE deleted_at IS NULL AND funding_max_eur >= 100000 AND funding_max_eur <= 250000""",
)
def filter_range(spark, sf_dir):
    rows = C.filter_corpus(orders_corpus(spark, sf_dir), min_funding=100000, max_funding=250000)
    return rows.select("grant_id", F.col("funding_max_eur").cast("double").alias("funding_max_eur"))


def _page(name: str, sort: str, order: str):
    @query(
        name,
        f"""WITH c AS ({ORDERS_SQL}) SELECT {_LIST} FROM c WHERE deleted_at IS NULL
        ORDER BY {order}, grant_id LIMIT 50 OFFSET 100""",
    )
    def job(spark, sf_dir):
        rows = C.filter_corpus(orders_corpus(spark, sf_dir))
        return C.as_list_items(C.page(rows, sort, limit=50, offset=100))

    return job


_page("corpus_page_newest", "created_at", "created_at DESC")
_page("corpus_page_deadline", "deadline", "deadline ASC NULLS LAST")
_page("corpus_page_funding", "funding_max", "funding_max_eur DESC NULLS LAST")


@query(
    "corpus_page_deep",
    f"""WITH c AS ({ORDERS_SQL}) SELECT {_LIST} FROM c WHERE deleted_at IS NULL
    ORDER BY funding_max_eur DESC NULLS LAST, grant_id LIMIT 200 OFFSET (SELECT count(*) * 7 // 10 FROM c WHERE deleted_at IS NULL)""",
)
def page_deep(spark, sf_dir):
    """A page behind seven tenths of the corpus, from the range that holds it."""
    rows = C.live(orders_corpus(spark, sf_dir)).select(*C.LIST_COLUMNS)
    pages = write_pages(rows, shared_path(spark, "pages"), "funding_max", range_rows=2_000)
    return C.as_list_items(pages.page(200, pages.total * 7 // 10))


@query(
    "corpus_page_meta",
    f"""WITH c AS ({ORDERS_SQL}) SELECT count(*) AS total, 50 AS "limit", 100 AS "offset",
    CAST(least(greatest(count(*) - 100, 0), 50) AS BIGINT) AS returned FROM c WHERE deleted_at IS NULL AND country = 'DE'""",
)
def page_meta(spark, sf_dir):
    return C.page_meta(C.filter_corpus(orders_corpus(spark, sf_dir), country="DE"), 50, 100)


@query(
    "corpus_point_lookup",
    f"WITH c AS ({ORDERS_SQL}) SELECT {_LIST}, body, summary_en FROM c WHERE deleted_at IS NULL AND grant_id = 1000",
)
def point_lookup(spark, sf_dir):
    return C.as_details(C.point_lookup(orders_corpus(spark, sf_dir), 1000))


@query("corpus_list_items", f"WITH c AS ({ORDERS_SQL}) SELECT {_LIST} FROM c WHERE deleted_at IS NULL")
def list_items(spark, sf_dir):
    return C.as_list_items(C.live(orders_corpus(spark, sf_dir)))


@query(
    "corpus_details",
    f"WITH c AS ({ORDERS_SQL}) SELECT {_LIST}, body, summary_en FROM c WHERE deleted_at IS NULL",
)
def details(spark, sf_dir):
    return C.as_details(C.live(orders_corpus(spark, sf_dir)))


# Each customer's orders, newest first, stand for a ranked id list.
_HITS_SQL = """
SELECT o_custkey AS qid, o_orderkey AS grant_id,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1 AS INTEGER) AS rank
FROM orders
"""


def _order_hits(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return rows.select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("grant_id"), (place - 1).cast("int").alias("rank"))


@query(
    "corpus_fetch_ranked",
    f"""WITH c AS ({ORDERS_SQL}), h AS ({_HITS_SQL}) SELECT h.qid, h.grant_id, h.rank, c.title, c.portal
    FROM h JOIN c ON c.grant_id = h.grant_id WHERE c.deleted_at IS NULL""",
)
def fetch_ranked(spark, sf_dir):
    hits = _order_hits(spark, sf_dir)
    return fetch_live(hits, orders_corpus(spark, sf_dir), ["title", "portal"], small=False).select(
        "qid", "grant_id", "rank", "title", "portal"
    )


@query(
    "corpus_search_hits",
    f"""WITH c AS ({ORDERS_SQL}), h AS ({_HITS_SQL}) SELECT h.qid, h.rank, {_LIST.replace("grant_id,", "c.grant_id,", 1)},
    1.0 / (h.rank + 1) AS final_score, c.source_doc_id || ' ' || c.source_url || ' ' || c.portal || ' ' || c.title AS citation
    FROM h JOIN c ON c.grant_id = h.grant_id WHERE c.deleted_at IS NULL""",
)
def search_hits(spark, sf_dir):
    hits = _order_hits(spark, sf_dir).withColumn("final_score", 1.0 / (F.col("rank") + 1))
    corpus = orders_corpus(spark, sf_dir)
    rows = fetch_live(hits, corpus, [c for c in corpus.columns if c not in ("grant_id", "deleted_at")], small=False)
    shaped = C.as_search_hits(rows)
    c = F.col("citation")
    return shaped.withColumn(
        "citation", F.concat_ws(" ", c["source_doc_id"], c["source_url"], c["portal"], c["title"])
    )


# --- run history ---------------------------------------------------------------

_RUNS_SQL = f"""
SELECT 'run-' || grant_id AS run_id, portal, created_at AS started_at,
       CASE status WHEN 'open' THEN 'success' WHEN 'closed' THEN 'failed' ELSE 'partial' END AS status
FROM ({ORDERS_SQL})
"""


@query(
    "run_history_portal",
    f"SELECT * FROM ({_RUNS_SQL}) WHERE portal = 'kfw' ORDER BY started_at DESC, run_id LIMIT 100",
)
def history_of_portal(spark, sf_dir):
    rows = orders_corpus(spark, sf_dir).select(
        F.concat(F.lit("run-"), F.col("grant_id").cast("string")).alias("run_id"),
        "portal",
        F.col("created_at").alias("started_at"),
        F.when(F.col("status") == "open", "success").when(F.col("status") == "closed", "failed").otherwise("partial").alias("status"),
    )
    return run_history(rows, "kfw", 100)
