"""Batch hybrid retrieval: modes, reranking, expansion and result assembly."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subventa.functions.text import hypothetical_descriptions
from subventa.functions.vectors import l2_normalise
from subventa.operators.bounds import MAX_BROADCAST_HITS
from subventa.operators.dense import dense_top_k
from subventa.operators.embed import EmbedFn, run_model, task_rows
from subventa.operators.fusion import reciprocal_rank_fusion
from subventa.operators.order import top_per_key
from subventa.operators.query_block import MAX_BLOCK_QUERIES, QueryBlock, held
from subventa.operators.sparse import sparse_top_k
from subventa.sources.deltas import DeltaTable
from subventa.sources.shared import shared_path, stored

DENSE, HYBRID, HYBRID_RERANK = "dense", "hybrid", "hybrid_rerank"
# Candidates per leg and into the reranker (fixed values).
DENSE_CANDIDATES = 50
SPARSE_CANDIDATES = 50
RERANK_INPUT = 50
DEFAULT_LIMIT = 10
MAX_HYPOTHETICALS = 3

ScoreFn = Callable[[pd.Series, pd.Series], pd.Series]


@dataclass(frozen=True)
class Retrieval:
    """Ranked hits and the candidate frames they came from.

    `small` tells that the query count bounds any per-query candidate list to
    what may be broadcast.
    """

    hits: DataFrame
    dense: DataFrame
    sparse: DataFrame | None
    fused: DataFrame | None
    reranked: DataFrame | None
    small: bool


def contains_scorer(queries: pd.Series, passages: pd.Series) -> pd.Series:
    """Stand-in reranker: 10 where the passage holds the query, else 1."""
    return pd.Series(
        [10.0 if q.lower() in p.lower() else 1.0 for q, p in zip(queries, passages)], dtype="float64"
    )


def mean_pool(vectors: DataFrame, key: str = "qid") -> DataFrame:
    """Mean of a key's vectors, renormalised. Sums combine map-side per dimension."""
    means = (
        vectors.select(key, F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "x"))
        .groupBy(key, "dim")
        .agg(F.avg("x").alias("x"))
    )
    # one entry per dimension, so this list is as long as a vector
    listed = means.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("_dims"))
    return listed.select(key, l2_normalise(F.col("_dims.x")).alias("embedding"))


def expand_queries(queries: DataFrame, hypothetical_vectors: DataFrame) -> DataFrame:
    """Replace the dense vector by the pooled hypotheticals where a query has some.

    `hypothetical_vectors`: qid, pos, embedding; the first three count.
    """
    first = top_per_key(hypothetical_vectors, ["qid"], [F.col("pos")], MAX_HYPOTHETICALS, rank="_rank")
    pooled = mean_pool(first).withColumnRenamed("embedding", "_pooled")
    return (
        queries.join(pooled, "qid", "left")
        .withColumn("used_hyde", F.col("_pooled").isNotNull())
        .withColumn("embedding", F.coalesce("_pooled", F.col("embedding").cast("array<double>")))
        .drop("_pooled")
    )


def hypothetical_vectors(replies: DataFrame, embed_fn: EmbedFn) -> DataFrame:
    """(qid, reply) to (qid, pos, embedding) of the first descriptions in each reply."""
    texts = replies.select(
        "qid", F.posexplode(F.slice(hypothetical_descriptions(F.col("reply")), 1, MAX_HYPOTHETICALS)).alias("pos", "d")
    ).select("qid", "pos", F.concat(F.lit("passage: "), F.col("d")).alias("text"))
    keyed = task_rows(texts)
    vectors = run_model(keyed.dropDuplicates(["key"]), embed_fn)
    return keyed.select("qid", "pos", "key").join(vectors, "key", "left").select("qid", "pos", "embedding")


def fetch_live(hits: DataFrame, corpus: DataFrame, columns: list[str], small: bool) -> DataFrame:
    """Corpus columns for each hit; rows gone since are dropped, ranks stay."""
    rows = corpus.filter(F.col("deleted_at").isNull()).select("grant_id", *columns)
    return rows.join(F.broadcast(hits) if small else hits, "grant_id")


def fetch_stored(hits: DataFrame, store: DeltaTable, columns: list[str]) -> DataFrame:
    """As fetch_live, from a corpus table keyed by grant_id: only the buckets of the hits are read."""
    rows = store.lookup(hits).filter(F.col("deleted_at").isNull()).select("grant_id", *columns)
    return rows.join(hits, "grant_id")


def rerank(fused: DataFrame, queries: DataFrame, corpus: DataFrame, score_fn: ScoreFn, small: bool) -> DataFrame:
    """Adds rerank_score to the best fused hits, scored over title and summary."""
    top = fused.filter(F.col("fused_rank") < RERANK_INPUT)
    pairs = (
        fetch_live(top, corpus, ["title", "summary"], small)
        .withColumn("passage", F.concat_ws("\n", "title", "summary"))
        .join(queries.select("qid", "query"), "qid")
        .select(*fused.columns, "query", "passage")
    )
    keep = fused.columns
    schema = T.StructType([*[fused.schema[c] for c in keep], T.StructField("rerank_score", T.DoubleType())])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = pd.Series(score_fn(batch["query"], batch["passage"]))
            yield batch[keep].assign(rerank_score=scores.astype("float64").values)

    return pairs.mapInPandas(score, schema)


def final_score(rerank_score: Column, rrf_score: Column, similarity: Column) -> Column:
    return F.coalesce(rerank_score, rrf_score, similarity)


_HIT = ("qid", "grant_id", "rank", "final_score", "dense_rank", "sparse_rank", "rrf_score", "rerank_score")


def _hit_columns(df: DataFrame) -> DataFrame:
    types = {"dense_rank": "int", "sparse_rank": "int", "rrf_score": "double", "rerank_score": "double"}
    for name, t in types.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(t))
    similarity = F.col("similarity") if "similarity" in df.columns else F.lit(None).cast("double")
    return df.withColumn("final_score", final_score(F.col("rerank_score"), F.col("rrf_score"), similarity)).select(*_HIT)


def retrieve(
    queries: DataFrame,
    corpus: DataFrame,
    mode: str = HYBRID_RERANK,
    limit: int = DEFAULT_LIMIT,
    score_fn: ScoreFn | None = None,
    dense: DataFrame | None = None,
    sparse: DataFrame | None = None,
    block: QueryBlock | None = None,
) -> Retrieval:
    """Ranked hits for a batch of queries.

    `queries`: qid, query, embedding, optional portal / country filters.
    `corpus`: grant_id, title, summary, embedding, deleted_at (+ filter columns).
    Legs that are known already may be handed in, and `block` where it holds
    the queries; a batch that fits one is fetched once for all legs.
    """
    if mode not in (DENSE, HYBRID, HYBRID_RERANK):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == HYBRID_RERANK and score_fn is None:
        raise ValueError("hybrid_rerank needs a score function")
    if block is None:
        block = held(queries, min(MAX_BLOCK_QUERIES, MAX_BROADCAST_HITS // RERANK_INPUT))
    small = block is not None and len(block) * RERANK_INPUT <= MAX_BROADCAST_HITS
    if block is not None:
        queries = block.frame
    if mode == DENSE:
        found = dense_top_k(queries, corpus, limit, block=block) if dense is None else dense.filter(F.col("rank") < limit)
        return Retrieval(_hit_columns(found.withColumn("dense_rank", F.col("rank"))), found, None, None, None, small)
    if dense is None:
        dense = dense_top_k(queries, corpus, DENSE_CANDIDATES, block=block)
    if sparse is None:
        sparse = sparse_top_k(queries, corpus, SPARSE_CANDIDATES, block=block)
    fused = reciprocal_rank_fusion(dense, sparse)
    if mode == HYBRID:
        hits = _hit_columns(fused.filter(F.col("fused_rank") < limit).withColumn("rank", F.col("fused_rank")))
        return Retrieval(hits, dense, sparse, fused, None, small)
    scored = rerank(fused, queries, corpus, score_fn, small)
    best = top_per_key(scored, ["qid"], [F.desc("rerank_score"), F.col("fused_rank")], limit)
    return Retrieval(_hit_columns(best), dense, sparse, fused, scored, small)


def stage_counts(result: Retrieval, queries: DataFrame) -> DataFrame:
    """Candidates per stage and query, zero where a stage had none.

    The legs are written once, at most their candidates per query, as three of the counts read them: each would run the
    search again.
    """
    spark = queries.sparkSession
    dense = stored(result.dense, shared_path(spark, "dense"))
    sparse = None if result.sparse is None else stored(result.sparse, shared_path(spark, "sparse"))
    fused = None if result.fused is None else stored(reciprocal_rank_fusion(dense, sparse), shared_path(spark, "fused"))

    def counted(df: DataFrame | None, name: str) -> DataFrame | None:
        if df is None:
            return None
        return df.groupBy("qid").agg(F.count(F.lit(1)).alias(name))

    out = queries.select("qid")
    stages = {
        "dense_count": counted(dense, "dense_count"),
        "sparse_count": counted(sparse, "sparse_count"),
        "fused_count": counted(fused, "fused_count"),
        "rerank_count": counted(
            None if result.reranked is None else fused.filter(F.col("fused_rank") < RERANK_INPUT), "rerank_count"
        ),
    }
    for name, stage in stages.items():
        if stage is not None:
            out = out.join(stage, "qid", "left")
        value = F.col(name) if stage is not None else F.lit(None)
        out = out.withColumn(name, F.coalesce(value, F.lit(0)).cast("bigint"))
    return out


def assemble(hits: DataFrame, corpus: DataFrame, columns: list[str], small: bool = False) -> DataFrame:
    """Final result rows with their ranks; rows gone since are dropped.

    Pass Retrieval.small so that a bounded hit list is broadcast and the corpus
    is only scanned.
    """
    return fetch_live(hits, corpus, columns, small)


def apply_fact_filters(queries: DataFrame, facts: DataFrame) -> DataFrame:
    """Only the planner's country becomes a filter, upper-cased."""
    country = facts.select("qid", F.upper(F.nullif(F.col("country"), F.lit(""))).alias("country"))
    return queries.drop("country").join(country, "qid", "left")


# Candidates handed on and characters of body shown (fixed values).
CANDIDATE_LIMIT = 8
EXCERPT_CHARS = 600


def body_excerpt(body: Column) -> Column:
    from subventa.functions.text import strip

    text = strip(F.coalesce(body, F.lit("")))
    cut = F.left(text, F.lit(EXCERPT_CHARS))
    return F.when(F.length(text) > EXCERPT_CHARS, F.concat(cut, F.lit("…"))).otherwise(cut)


def iso_utc(ts: Column) -> Column:
    """ISO text of a UTC stamp; microseconds only when there are some."""
    micros = F.date_format(ts, "SSSSSS")
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(base, F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def flatten_candidates(hits: DataFrame, corpus: DataFrame, small: bool = False) -> DataFrame:
    """One flat row per kept hit, ready for prompts."""
    top = hits.filter(F.col("rank") < CANDIDATE_LIMIT)
    have = [
        c
        for c in (
            "title", "portal", "source_url", "source_doc_id", "summary", "body", "country", "federal_state",
            "funding_min_eur", "funding_max_eur", "deadline", "sector", "eligibility",
        )
        if c in corpus.columns
    ]
    rows = assemble(top, corpus, have, small)
    changes = {}
    if "body" in have:
        changes["body_excerpt"] = body_excerpt(F.col("body"))
    if "summary" in have:
        changes["summary"] = F.coalesce("summary", F.lit(""))
    for c in ("funding_min_eur", "funding_max_eur"):
        if c in have:
            changes[c] = F.col(c).cast("double")
    if "deadline" in have:
        changes["deadline"] = iso_utc(F.col("deadline"))
    return rows.withColumns(changes).drop("body")
