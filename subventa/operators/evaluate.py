"""Retrieval quality against graded gold sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subventa.operators.dense import dense_top_k
from subventa.operators.order import top_per_key
from subventa.operators.query_block import QueryBlock, held
from subventa.operators.retrieve import (
    DENSE,
    DENSE_CANDIDATES,
    HYBRID,
    HYBRID_RERANK,
    SPARSE_CANDIDATES,
    ScoreFn,
    expand_queries,
    retrieve,
)
from subventa.operators.sparse import sparse_top_k

# Sweep order, results per query and report text width (fixed values).
CONFIGS = (
    (0, DENSE, False),
    (1, HYBRID, False),
    (2, HYBRID_RERANK, False),
    (3, HYBRID_RERANK, True),
)
FETCHED = 10
TEXT_WIDTH = 60


def config_label(mode: str, use_hyde: bool) -> str:
    return f"{mode}+hyde" if use_hyde else mode


def graded_gains(gold: DataFrame) -> DataFrame:
    """(qid, doc, gain): relevant 1, ideal 2, ideal wins."""
    return gains_of(
        gold.select("qid", F.explode("ideal").alias("doc")), gold.select("qid", F.explode("relevant").alias("doc"))
    )


def gains_of(ideal: DataFrame, relevant: DataFrame) -> DataFrame:
    """The same from (qid, doc) rows, for gold sets too large for lists."""
    graded = ideal.select("qid", "doc", F.lit(2).alias("gain")).unionByName(
        relevant.select("qid", "doc", F.lit(1).alias("gain"))
    )
    return graded.groupBy("qid", "doc").agg(F.max("gain").alias("gain"))


def _discount(rank: Column) -> Column:
    return F.log2(rank + F.lit(2))


def ideal_dcg(gains: DataFrame, k: int) -> DataFrame:
    best = top_per_key(gains, ["qid"], [F.desc("gain"), F.col("doc")], k, rank="_i")
    return best.groupBy("qid").agg(F.sum(F.col("gain") / _discount(F.col("_i"))).alias("idcg"))


def query_metrics(
    ranked: DataFrame, gains: DataFrame, requests: DataFrame, precision_k: int = 5, recall_k: int = 10, ndcg_k: int = 10
) -> DataFrame:
    """Metrics per request row.

    `ranked`: config, qid, doc, rank (0-based); `requests`: the (config, qid)
    pairs asked for, which keeps queries without any hit at zero.
    """
    graded = ranked.join(gains, ["qid", "doc"], "left").withColumn("gain", F.coalesce("gain", F.lit(0)))
    rank, gain = F.col("rank"), F.col("gain")

    def reciprocal(threshold: int) -> Column:
        first = F.min(F.when(gain >= threshold, rank))
        return F.coalesce(1.0 / (first + 1), F.lit(0.0))

    per_query = graded.groupBy("config", "qid").agg(
        F.count_if((rank < precision_k) & (gain > 0)).alias("_hits_p"),
        F.count_if((rank < recall_k) & (gain > 0)).alias("_hits_r"),
        F.sum(F.when(rank < ndcg_k, gain / _discount(rank)).otherwise(0.0)).alias("_dcg"),
        reciprocal(1).alias("mrr_lenient"),
        reciprocal(2).alias("mrr_strict"),
    )
    positives = gains.filter(F.col("gain") > 0).groupBy("qid").agg(F.count(F.lit(1)).alias("_pos"))
    zero = F.lit(0.0)
    precision = F.col("_hits_p") / F.lit(precision_k) if precision_k > 0 else F.lit(0.0)
    return (
        requests.join(per_query, ["config", "qid"], "left")
        .join(positives, "qid", "left")
        .join(ideal_dcg(gains, ndcg_k), "qid", "left")
        .select(
            *requests.columns,
            F.coalesce(precision, zero).alias("precision_5"),
            F.coalesce(F.try_divide(F.col("_hits_r"), F.col("_pos")), zero).alias("recall_10"),
            F.coalesce(F.try_divide(F.col("_dcg"), F.col("idcg")), zero).alias("ndcg_10"),
            F.coalesce("mrr_lenient", zero).alias("mrr_lenient"),
            F.coalesce("mrr_strict", zero).alias("mrr_strict"),
        )
    )


def ranked_docs(hits: DataFrame, corpus: DataFrame, small: bool = False) -> DataFrame:
    """Hits renamed to document ids; live rows with one only, ranks closed up.

    Say `small` where the query count bounds the hits to what may be broadcast.
    """
    ids = corpus.filter(F.col("deleted_at").isNull() & F.col("source_doc_id").isNotNull()).select(
        "grant_id", F.col("source_doc_id").alias("doc")
    )
    named = ids.join(F.broadcast(hits) if small else hits, "grant_id")
    order = Window.partitionBy("config", "qid").orderBy("rank")
    return named.select("config", "qid", "doc", (F.row_number().over(order) - 1).alias("rank"))


def sweep(
    queries: DataFrame,
    corpus: DataFrame,
    hypothetical_vectors: DataFrame,
    score_fn: ScoreFn,
    configs=CONFIGS,
    block: QueryBlock | None = None,
) -> DataFrame:
    """Hits of every query under every configuration, cache off.

    The queries are fetched once, and once more with their expansions. The text
    leg serves all configurations and the vector leg all those without
    expansion, so each corpus pass is planned once and its shuffle reused.
    """
    block = block or held(queries)
    queries = queries if block is None else block.frame
    sparse = sparse_top_k(queries, corpus, SPARSE_CANDIDATES, block=block)
    legs: dict[bool, tuple[DataFrame, DataFrame, QueryBlock | None]] = {}
    out = None
    for _, mode, use_hyde in configs:
        if use_hyde not in legs:
            asked, own = queries, block
            if use_hyde:
                asked = expand_queries(queries, hypothetical_vectors)
                own = None if block is None else held(asked)
                asked = asked if own is None else own.frame
            legs[use_hyde] = (asked, dense_top_k(asked, corpus, DENSE_CANDIDATES, block=own), own)
        asked, dense, own = legs[use_hyde]
        hits = retrieve(asked, corpus, mode, FETCHED, score_fn, dense, sparse, own).hits
        hits = hits.select(F.lit(config_label(mode, use_hyde)).alias("config"), "qid", "grant_id", "rank")
        out = hits if out is None else out.unionByName(hits)
    return out


def config_order(config: Column) -> Column:
    out = None
    for position, mode, use_hyde in CONFIGS:
        hit = config == config_label(mode, use_hyde)
        out = F.when(hit, position) if out is None else out.when(hit, position)
    return out


def aggregate_configs(rows: DataFrame) -> DataFrame:
    """Mean metrics and median / mean latency per configuration, best nDCG first."""
    metrics = ("precision_5", "recall_10", "ndcg_10", "mrr_lenient", "mrr_strict")
    return (
        rows.groupBy("config")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(m).alias(m) for m in metrics],
            F.median("elapsed_ms").alias("p50_ms"),
            F.avg("elapsed_ms").alias("mean_ms"),
        )
        .orderBy(F.desc("ndcg_10"), config_order(F.col("config")))
    )


def query_winners(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Best configuration per query by nDCG, first in sweep order on a tie."""
    best = top_per_key(
        rows.withColumn("_o", config_order(F.col("config"))), ["qid"], [F.desc("ndcg_10"), F.col("_o")], 1
    )
    text = F.when(F.length("query") <= TEXT_WIDTH, F.col("query")).otherwise(
        F.concat(F.left("query", F.lit(TEXT_WIDTH - 3)), F.lit("..."))
    )
    return best.join(queries.select("qid", "query"), "qid").select(
        "qid", text.alias("query"), F.col("config").alias("winner"), "ndcg_10"
    )
