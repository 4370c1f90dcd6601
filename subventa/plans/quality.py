"""Retrieval quality over the search corpus: gains, metrics, sweep, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from subventa.operators import evaluate as V
from subventa.operators import retrieve as R
from subventa.operators.bounds import MAX_BROADCAST_HITS
from subventa.operators.query_block import held
from subventa.plans.corpora import documents_corpus, search_queries
from subventa.plans.registry import query, table
from subventa.plans.search import (
    _HYPO_SQL,
    BASE_SQL,
    HYBRID_SQL,
    NUMBERED_SQL,
    _dense_leg,
    _fused_leg,
    _reranked_leg,
    deal_to_queries,
    hypothetical_rows,
)

# Every document with a vector label is judged for one query of that label: it
# is relevant, and ideal if it is labelled as good besides.
_GAINS_SQL = """
gains AS (SELECT qn.qid, c.source_doc_id AS doc, CAST(CASE WHEN c.quality = 1 THEN 2 ELSE 1 END AS INTEGER) AS gain
  FROM qn JOIN c ON c.label = qn.label AND c.grant_id % qn.n = qn.i)
"""


def gold_gains(spark, sf_dir):
    """Gains from (qid, doc) rows; no list per query is ever built."""
    docs = documents_corpus(spark, sf_dir).filter(F.col("label").isNotNull())
    dealt = deal_to_queries(docs, search_queries(spark, sf_dir), "grant_id").withColumn("doc", F.col("source_doc_id"))
    return V.gains_of(dealt.filter(F.col("quality") == 1).select("qid", "doc"), dealt.select("qid", "doc"))


@query("eval_gains", f"{BASE_SQL}, {NUMBERED_SQL}, {_GAINS_SQL} SELECT * FROM gains")
def eval_gains(spark, sf_dir):
    return gold_gains(spark, sf_dir)


_SWEEP_SQL = f"""{HYBRID_SQL}, {_HYPO_SQL}, {_GAINS_SQL}, {_dense_leg('hdense', 'hq')}, {_fused_leg('hfused', 'hdense')}, {_reranked_leg('hreranked', 'hfused')},
hits AS (
  SELECT 'dense' AS config, qid, grant_id, rank FROM dense WHERE rank < 10
  UNION ALL SELECT 'hybrid', qid, grant_id, fused_rank FROM fused WHERE fused_rank < 10
  UNION ALL SELECT 'hybrid_rerank', qid, grant_id, rank FROM reranked WHERE rank < 10
  UNION ALL SELECT 'hybrid_rerank+hyde', qid, grant_id, rank FROM hreranked WHERE rank < 10),
ranked AS (SELECT config, qid, c.source_doc_id AS doc, row_number() OVER (PARTITION BY config, qid ORDER BY rank) - 1 AS rank FROM hits JOIN c USING (grant_id)),
asked AS (SELECT * FROM (VALUES ('dense', 0), ('hybrid', 1), ('hybrid_rerank', 2), ('hybrid_rerank+hyde', 3)) AS s(config, ord) CROSS JOIN (SELECT qid FROM q)),
graded AS (SELECT ranked.*, coalesce(gain, 0) AS gain FROM ranked LEFT JOIN gains USING (qid, doc)),
pos AS (SELECT qid, count(*) AS positives FROM gains WHERE gain > 0 GROUP BY qid),
ideal AS (SELECT qid, sum(gain / log2(i + 2)) AS idcg FROM (SELECT qid, gain, row_number() OVER (PARTITION BY qid ORDER BY gain DESC, doc) - 1 AS i FROM gains) WHERE i < 10 GROUP BY qid),
m AS (SELECT config, qid, count(*) FILTER (rank < 5 AND gain > 0) AS h5, count(*) FILTER (rank < 10 AND gain > 0) AS h10,
    sum(CASE WHEN rank < 10 THEN gain / log2(rank + 2) ELSE 0 END) AS dcg,
    min(rank) FILTER (gain >= 1) AS first1, min(rank) FILTER (gain >= 2) AS first2 FROM graded GROUP BY config, qid),
metrics AS (SELECT asked.config, asked.ord, asked.qid, coalesce(h5 / 5, 0) AS precision_5, coalesce(h10 / positives, 0) AS recall_10,
    coalesce(dcg / idcg, 0) AS ndcg_10, coalesce(1.0 / (first1 + 1), 0) AS mrr_lenient, coalesce(1.0 / (first2 + 1), 0) AS mrr_strict,
    CAST((asked.ord + 1) * asked.qid + 7 AS BIGINT) AS elapsed_ms
  FROM asked LEFT JOIN m USING (config, qid) LEFT JOIN pos USING (qid) LEFT JOIN ideal USING (qid))
"""


def _named(spark, sf_dir):
    block = held(search_queries(spark, sf_dir))
    small = block is not None and len(block) * V.FETCHED * len(V.CONFIGS) <= MAX_BROADCAST_HITS
    return V.ranked_docs(_hits(spark, sf_dir, block), documents_corpus(spark, sf_dir), small)


def _hits(spark, sf_dir, block=None):
    queries = search_queries(spark, sf_dir) if block is None else block.frame
    return V.sweep(queries, documents_corpus(spark, sf_dir), hypothetical_rows(spark, sf_dir, queries), R.contains_scorer, block=block)


def _requests(spark, sf_dir):
    """Every query under every configuration, with a made-up latency."""
    configs = F.array(
        *[F.struct(F.lit(V.config_label(m, h)).alias("config"), F.lit(o).alias("ord")) for o, m, h in V.CONFIGS]
    )
    each = search_queries(spark, sf_dir).select("qid", F.explode(configs).alias("c"))
    return each.select("c.config", "qid", ((F.col("c.ord") + 1) * F.col("qid") + 7).cast("bigint").alias("elapsed_ms"))


def _metrics(spark, sf_dir):
    return V.query_metrics(_named(spark, sf_dir), gold_gains(spark, sf_dir), _requests(spark, sf_dir))


_METRICS = ("precision_5", "recall_10", "ndcg_10", "mrr_lenient", "mrr_strict")


def _round(df, columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("eval_sweep", f"{_SWEEP_SQL} SELECT config, qid, grant_id, CAST(rank AS INTEGER) AS rank FROM hits")
def eval_sweep(spark, sf_dir):
    return _hits(spark, sf_dir)


@query("eval_ranked_docs", f"{_SWEEP_SQL} SELECT config, qid, doc, CAST(rank AS INTEGER) AS rank FROM ranked")
def eval_ranked_docs(spark, sf_dir):
    return _named(spark, sf_dir)


@query(
    "eval_query_metrics",
    f"{_SWEEP_SQL} SELECT config, qid, {', '.join(f'CAST(round({m}, 6) AS DOUBLE) AS {m}' for m in _METRICS)} FROM metrics",
)
def eval_query_metrics(spark, sf_dir):
    return _round(_metrics(spark, sf_dir), _METRICS).drop("elapsed_ms")


@query(
    "eval_config_report",
    f"""{_SWEEP_SQL} SELECT config, count(*) AS n, {', '.join(f'CAST(round(avg({m}), 6) AS DOUBLE) AS {m}' for m in _METRICS)},
      median(elapsed_ms) AS p50_ms, round(avg(elapsed_ms), 6) AS mean_ms FROM metrics GROUP BY config""",
)
def eval_config_report(spark, sf_dir):
    return _round(V.aggregate_configs(_metrics(spark, sf_dir)), (*_METRICS, "mean_ms"))


@query(
    "eval_query_winners",
    f"""{_SWEEP_SQL} SELECT w.qid, CASE WHEN length(q.query) <= 60 THEN q.query ELSE q.query[:57] || '...' END AS query, w.config AS winner,
      CAST(round(round(w.ndcg_10, 9), 6) AS DOUBLE) AS ndcg_10
    FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(ndcg_10, 9) DESC, ord) AS rn FROM metrics) w JOIN q ON q.qid = w.qid WHERE w.rn = 1""",
)
def eval_query_winners(spark, sf_dir):
    rows = _metrics(spark, sf_dir).withColumn("ndcg_10", F.round("ndcg_10", 9))
    return _round(V.query_winners(rows, search_queries(spark, sf_dir)), ("ndcg_10",))


# Metrics alone, on the customers' order lists: gains come from price and status.
@query(
    "eval_metrics_on_orders",
    """WITH ranked AS (SELECT 'date' AS config, o_custkey AS qid, o_orderkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS rank FROM orders),
    gains AS (SELECT o_custkey AS qid, o_orderkey AS doc, CASE WHEN o_totalprice > 300000 THEN 2 ELSE 1 END AS gain FROM orders WHERE o_totalprice > 200000),
    pos AS (SELECT qid, count(*) AS positives FROM gains GROUP BY qid),
    ideal AS (SELECT qid, sum(gain / log2(i + 2)) AS idcg FROM (SELECT qid, gain, row_number() OVER (PARTITION BY qid ORDER BY gain DESC, doc) - 1 AS i FROM gains) WHERE i < 10 GROUP BY qid),
    m AS (SELECT config, r.qid, count(*) FILTER (rank < 5 AND gain > 0) AS h5, count(*) FILTER (rank < 10 AND gain > 0) AS h10,
      sum(CASE WHEN rank < 10 THEN coalesce(gain, 0) / log2(rank + 2) ELSE 0 END) AS dcg, min(rank) FILTER (gain >= 1) AS f1, min(rank) FILTER (gain >= 2) AS f2
      FROM ranked r LEFT JOIN gains g ON g.qid = r.qid AND g.doc = r.doc GROUP BY ALL)
    SELECT 'date' AS config, c.c_custkey AS qid, CAST(round(coalesce(h5 / 5, 0), 6) AS DOUBLE) AS precision_5, CAST(round(coalesce(h10 / positives, 0), 6) AS DOUBLE) AS recall_10,
      CAST(round(coalesce(dcg / idcg, 0), 6) AS DOUBLE) AS ndcg_10, CAST(round(coalesce(1.0 / (f1 + 1), 0), 6) AS DOUBLE) AS mrr_lenient,
      CAST(round(coalesce(1.0 / (f2 + 1), 0), 6) AS DOUBLE) AS mrr_strict
    FROM customer c LEFT JOIN m ON m.qid = c.c_custkey LEFT JOIN pos ON pos.qid = c.c_custkey LEFT JOIN ideal ON ideal.qid = c.c_custkey""",
)
def eval_metrics_on_orders(spark, sf_dir):
    from subventa.operators.order import blocked_rank

    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("doc"), "o_totalprice", "o_orderdate"
    )
    ranked = blocked_rank(
        orders, ["qid"], [F.col("o_orderdate"), F.col("doc")], F.year("o_orderdate"), "rank"
    ).select(F.lit("date").alias("config"), "qid", "doc", "rank")
    price = F.col("o_totalprice")
    gains = orders.filter(price > 200000).select("qid", "doc", F.when(price > 300000, 2).otherwise(1).alias("gain"))
    requests = table(spark, sf_dir, "customer").select(F.lit("date").alias("config"), F.col("c_custkey").alias("qid"))
    return _round(V.query_metrics(ranked, gains, requests), _METRICS)
