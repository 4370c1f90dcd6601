"""Semantic result cache as a table: lookup, store, eligibility, rehydration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subventa.functions.vectors import quantised_key
from subventa.operators.dense import DIGITS
from subventa.operators.retrieve import DEFAULT_LIMIT, HYBRID_RERANK, ScoreFn, fetch_live, retrieve, stage_counts

# Match threshold, entries kept and their life time (fixed values).
MIN_SIMILARITY = 0.95
MAX_ENTRIES = 200
TTL_SECONDS = 86_400

# Filters and limit belong to an entry's identity next to its vector.
SCOPE = ("portal", "country", "limit")


def cache_key(embedding: Column) -> Column:
    return quantised_key(embedding)


def eligible(mode: Column, use_hyde: Column) -> Column:
    return (mode == HYBRID_RERANK) & ~use_hyde


def newest_entries(cache: DataFrame, now: Column, max_entries: int = MAX_ENTRIES) -> DataFrame:
    alive = cache.filter(F.unix_micros("cached_at") > F.unix_micros(now) - F.lit(TTL_SECONDS * 1_000_000))
    return alive.orderBy(F.desc("cached_at"), F.col("key")).limit(max_entries)


def store(cache: DataFrame, entries: DataFrame, now: Column, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """Next cache table: latest entry per key and scope, newest `max_entries`, none expired."""
    both = cache.unionByName(entries.withColumn("key", cache_key(F.col("embedding"))))
    scope = [c for c in SCOPE if c in both.columns]
    rest = [c for c in both.columns if c not in ("key", *scope)]
    latest = (
        both.groupBy("key", *scope)
        .agg(F.max_by(F.struct(*rest), F.struct("cached_at", "query")).alias("_r"))
        .select("key", *scope, "_r.*")
    )
    return newest_entries(latest, now, max_entries)


def lookup(
    queries: DataFrame,
    cache: DataFrame,
    now: Column,
    min_similarity: float = MIN_SIMILARITY,
    max_entries: int = MAX_ENTRIES,
) -> DataFrame:
    """(qid, key, query, similarity): best live entry per query at or above the threshold.

    Queries are only scanned; the entries travel to the tasks and are at most
    `max_entries`. The newest entry wins a tie.
    """
    scope = [c for c in SCOPE if c in queries.columns and c in cache.columns]
    held = newest_entries(cache, now, max_entries).select("key", "query", "embedding", "cached_at", *scope).toPandas()
    held = held.sort_values(["cached_at", "key"], ascending=[False, True]).reset_index(drop=True)
    block = queries.sparkSession.sparkContext.broadcast(held)
    schema = T.StructType(
        [
            T.StructField("qid", queries.schema["qid"].dataType),
            T.StructField("key", T.StringType()),
            T.StructField("cached_for_query", T.StringType()),
            T.StructField("similarity", T.DoubleType()),
        ]
    )

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries = block.value
        if entries.empty:
            return
        vectors = np.array([np.asarray(v, dtype=np.float64) for v in entries["embedding"]])
        for batch in batches:
            if batch.empty:
                continue
            own = np.array([np.asarray(v, dtype=np.float64) for v in batch["embedding"]])
            sims = np.round(own @ vectors.T, DIGITS)
            for c in scope:
                left, right = batch[c].to_numpy(dtype=object), entries[c].to_numpy(dtype=object)
                missing = np.equal.outer(pd.isna(left), pd.isna(right)) & pd.isna(left)[:, None]
                sims[~((left[:, None] == right[None, :]) | missing)] = -np.inf
            best = sims.argmax(axis=1)
            value = sims[np.arange(len(own)), best]
            hit = value >= min_similarity
            yield pd.DataFrame(
                {
                    "qid": batch["qid"].to_numpy()[hit],
                    "key": entries["key"].to_numpy()[best[hit]],
                    "cached_for_query": entries["query"].to_numpy()[best[hit]],
                    "similarity": value[hit],
                }
            )

    return queries.filter(F.col("embedding").isNotNull()).select("qid", "embedding", *scope).mapInPandas(match, schema)


def rehydrate(entries: DataFrame, corpus: DataFrame, columns: list[str], small: bool = False) -> DataFrame:
    """Stored hits joined to current rows; vanished rows are skipped.

    `entries`: key, hits array<struct<grant_id, final_score, ...>>. Say `small`
    for a cache's worth of entries, each with one result page of hits.
    """
    exploded = entries.select("key", F.posexplode("hits").alias("position", "h")).select("key", "position", "h.*")
    return fetch_live(exploded, corpus, columns, small)


_RANKS = ("dense_rank", "sparse_rank", "rrf_score", "rerank_score")


@dataclass(frozen=True)
class CachedRetrieval:
    """`hits` of all queries with cache_hit and cached_for_query, `counts` per query, and the next cache table."""

    hits: DataFrame
    counts: DataFrame
    cache: DataFrame


def retrieve_cached(
    queries: DataFrame, corpus: DataFrame, cache: DataFrame, now: Column, score_fn: ScoreFn, limit: int = DEFAULT_LIMIT
) -> CachedRetrieval:
    """Reranked hits for a batch: stored results where an entry matches, retrieval for the misses alone.

    `cache`: key, query, embedding, cached_at, hits, dense_count ... rerank_count,
    and those of SCOPE that `queries` has. Grants gone since are skipped from a
    stored result. What was retrieved becomes an entry of the next cache.
    """
    scope = [c for c in SCOPE if c in queries.columns and c in cache.columns]
    names = ["dense_count", "sparse_count", "fused_count", "rerank_count"]
    found = lookup(queries, cache, now).join(queries.select("qid", *scope), "qid")
    held = newest_entries(cache, now).select("key", *scope, "hits", *names)
    same = F.col("f.key") == F.col("c.key")
    for c in scope:
        same = same & F.col(f"f.{c}").eqNullSafe(F.col(f"c.{c}"))
    # At most MAX_ENTRIES entries of one result page each.
    served = found.alias("f").join(F.broadcast(held.alias("c")), same).select("f.qid", "f.cached_for_query", "c.hits", *[f"c.{n}" for n in names])
    stored = served.select("qid", "cached_for_query", F.explode("hits").alias("h")).select("qid", "cached_for_query", "h.*")
    stored = fetch_live(stored, corpus, [], small=False).withColumn("cache_hit", F.lit(True))

    misses = queries.join(found.select("qid"), "qid", "left_anti")
    result = retrieve(misses, corpus, HYBRID_RERANK, limit, score_fn)
    fresh = result.hits.withColumns({"cache_hit": F.lit(False), "cached_for_query": F.lit(None).cast("string")})
    counted = stage_counts(result, misses)

    page = result.hits.groupBy("qid").agg(
        F.sort_array(F.collect_list(F.struct("rank", "grant_id", "final_score", *_RANKS))).alias("hits")
    )
    entries = misses.select("qid", "query", "embedding", *scope).join(page, "qid").join(counted, "qid").drop("qid").withColumn("cached_at", now)
    columns = ["qid", "grant_id", "rank", "final_score", *_RANKS, "cache_hit", "cached_for_query"]
    counts = counted.select("qid", *names).unionByName(served.select("qid", *names))
    return CachedRetrieval(fresh.select(columns).unionByName(stored.select(columns)), counts, store(cache, entries, now))
