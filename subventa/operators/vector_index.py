"""Vectors in lists by their nearest centre, written once and searched many times.

Centres come from spherical k-means over a bounded sample; every live row is then put into
the list of its nearest centre, whatever the sample held. Lists with many more rows than
the mean are split again, so that probing a list costs about the same everywhere.

A list keeps the widest angle between its centre and a row. No row of the list can be nearer
to a query than the angle to the centre less that width, so a search knows which lists can
still hold a better row than the k best it has: with `exact` it reads those too, and its
result is that of a full scan.

Below the root: rows/list=L (unit vectors), their shape, and lists (centre, width, rows).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subventa.operators.bounds import collect_within, spread_small
from subventa.operators.dense import DIGITS, _by_blocks, _merged, _sides, _unit, filter_groups
from subventa.operators.query_block import MAX_BLOCK_QUERIES
from subventa.operators.running_top import RunningTop

# Rows the centres are fitted on, per list and in all.
SAMPLE_PER_LIST, SAMPLE_ROWS = 64, 100_000
ROUNDS = 12
# A list is split when it has so many times the mean.
UNEVEN = 3
_SLACK = 1e-9


@dataclass(frozen=True)
class VectorIndex:
    """`rows`: grant_id, embedding (unit), filter columns, list. The driver has the centres, as many as there are lists."""

    rows: DataFrame
    centres: np.ndarray
    widths: np.ndarray
    sizes: np.ndarray


def centres_of(sample: np.ndarray, lists: int, seed: int = 42) -> np.ndarray:
    """Unit centres by spherical k-means, begun far from each other."""
    rng = np.random.default_rng(seed)
    lists = min(lists, len(sample))
    chosen = [int(rng.integers(len(sample)))]
    near = sample @ sample[chosen[0]]
    while len(chosen) < lists:
        far = np.clip(1 - near, 0, None) ** 2
        total = far.sum()
        chosen.append(int(rng.choice(len(sample), p=far / total)) if total > 0 else int(rng.integers(len(sample))))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    centres = sample[chosen].copy()
    for _ in range(ROUNDS):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1)
        moved = np.where(norm[:, None] > 0, sums / np.where(norm > 0, norm, 1)[:, None], centres)
        if np.allclose(moved, centres, atol=1e-6):
            break
        centres = moved
    return centres


def _sampled(rows: DataFrame, n: int) -> np.ndarray:
    """Unit vectors of the `n` rows first by the hash of their id: the same rows however the table is cut."""
    taken = rows.orderBy(F.xxhash64("grant_id"), "grant_id").limit(n).select("embedding").toPandas()["embedding"]
    unit = _unit(taken) if len(taken) else np.zeros((0, 1))
    return unit[np.isfinite(unit).all(axis=1)]


def _listed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Unit vectors with their list and the cosine to its centre; rows without a direction belong to no list."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)
    schema = T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("near", T.DoubleType())])

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            unit = _unit(batch["embedding"])
            fine = np.isfinite(unit).all(axis=1)
            batch, unit = batch[fine], unit[fine]
            if batch.empty:
                continue
            near = unit @ sent.value.T
            own = near.argmax(axis=1)
            yield batch.assign(embedding=list(unit), list=own.astype(np.int32), near=near[np.arange(len(own)), own])

    return spread_small(rows).mapInPandas(put, schema)


def build_index(corpus: DataFrame, root: str, lists: int, seed: int = 42) -> VectorIndex:
    """Write the live rows with a vector as lists below `root`. Rows with a zero vector are similar to nothing and are left out."""
    spark = corpus.sparkSession
    filters = [c for c in ("portal", "country") if c in corpus.columns]
    rows = corpus.filter(F.col("deleted_at").isNull() & F.col("embedding").isNotNull())
    rows = rows.select("grant_id", F.col("embedding").cast("array<double>").alias("embedding"), *filters)
    sample = _sampled(rows, min(SAMPLE_ROWS, lists * SAMPLE_PER_LIST))
    if not len(sample):
        centres = np.zeros((0, 1))
    else:
        centres = centres_of(sample, lists, seed)
        # Large lists get centres of their own, in place of the one they share. A list of equal vectors stays one.
        counts = {r["list"]: r["n"] for r in _listed(rows, centres).groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
        mean = max(1, sum(counts.values()) / len(centres))
        large = [i for i, n in counts.items() if n > UNEVEN * mean]
        if large:
            listed = _listed(rows, centres)
            parts = [c for i, c in enumerate(centres) if i not in large]
            for i in sorted(large):
                inside = _sampled(listed.filter(F.col("list") == i), SAMPLE_PER_LIST * int(UNEVEN * 2))
                parts.extend(centres_of(inside, int(np.ceil(counts[i] / mean)), seed))
            centres = np.unique(np.round(np.array(parts), 12), axis=0)
            centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    listed = _listed(rows, centres) if len(centres) else rows.limit(0).selectExpr("*", "0 as list", "0D as near")
    listed.repartition("list", F.pmod(F.xxhash64("grant_id"), F.lit(8))).write.mode("overwrite").partitionBy("list").parquet(f"{root}/rows")
    rows.limit(0).write.mode("overwrite").parquet(f"{root}/shape")
    schema = T.StructType([*rows.schema.fields, T.StructField("near", T.DoubleType()), T.StructField("list", T.IntegerType())])
    stats = spark.read.schema(schema).parquet(f"{root}/rows").groupBy("list").agg(F.min("near").alias("near"), F.count(F.lit(1)).alias("n")).collect()
    width, size = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in stats:
        width[r["list"]], size[r["list"]] = np.arccos(np.clip(r["near"], -1, 1)), r["n"]
    table = [(i, [float(x) for x in c], float(w), int(n)) for i, (c, w, n) in enumerate(zip(centres, width, size))]
    spark.createDataFrame(table, "list int, centre array<double>, width double, n long").coalesce(1).write.mode("overwrite").parquet(f"{root}/lists")
    return open_index(spark, root)


def open_index(spark: SparkSession, root: str) -> VectorIndex:
    lists = spark.read.parquet(f"{root}/lists").orderBy("list").toPandas()
    shape = spark.read.parquet(f"{root}/shape").schema
    rows = spark.read.schema(T.StructType([*shape.fields, T.StructField("list", T.IntegerType())])).parquet(f"{root}/rows")
    centres = np.array([np.asarray(c, float) for c in lists["centre"]]) if len(lists) else np.zeros((0, 1))
    return VectorIndex(rows, centres, lists["width"].to_numpy(), lists["n"].to_numpy())


def _probes(index: VectorIndex, unit: np.ndarray, probes: int) -> np.ndarray:
    """(queries, lists): whether a query looks into a list, the `probes` nearest centres that have rows."""
    near = np.where(index.sizes > 0, unit @ index.centres.T, -np.inf)
    wanted = np.zeros(near.shape, bool)
    first = np.argsort(-near, axis=1, kind="stable")[:, :probes]
    np.put_along_axis(wanted, first, True, axis=1)
    return wanted & (index.sizes > 0)


def can_hold_better(index: VectorIndex, unit: np.ndarray, kth: np.ndarray) -> np.ndarray:
    """(queries, lists): whether a list may have a row at least as similar as `kth` (minus infinity: fewer than k yet)."""
    angle = np.arccos(np.clip(unit @ index.centres.T, -1, 1))
    best = np.cos(np.maximum(0, angle - index.widths[None, :]))
    return (best >= kth[:, None] - 10.0**-DIGITS - _SLACK) & (index.sizes > 0)


def _search(index: VectorIndex, queries: pd.DataFrame, wanted: np.ndarray, k: int, schema: T.StructType):
    """Best rows of the lists each query wants; only those lists are read."""
    spark = index.rows.sparkSession
    sent = spark.sparkContext.broadcast((queries, _unit(queries["embedding"]) if len(queries) else None, wanted))
    lists = [int(i) for i in np.flatnonzero(wanted.any(axis=0))]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, unit, wants = sent.value
        if asked.empty:
            return
        top = RunningTop(asked["qid"].to_numpy(), k)
        groups = filter_groups(asked)
        for batch in batches:
            for number, rows in batch.groupby("list", sort=False):
                vectors = np.array(rows["embedding"].tolist())
                ids = rows["grant_id"].to_numpy()
                for filters, members in groups:
                    members = members[wants[members, number]]
                    use = np.ones(len(ids), bool)
                    for column, value in filters.items():
                        use &= rows[column].to_numpy() == value
                    if len(members) and use.any():
                        for q, sims in zip(members, np.round(unit[members] @ vectors[use].T, DIGITS)):
                            top.offer(q, ids[use], sims)
        yield from top.frames("similarity")

    rows = spread_small(index.rows.filter(F.col("list").isin(lists)))
    return rows.mapInPandas(scan, schema), sent


def index_top_k(queries: DataFrame, index: VectorIndex, k: int = 50, probes: int = 8, exact: bool = False, max_block_queries: int = MAX_BLOCK_QUERIES) -> DataFrame:
    """As dense_top_k over the rows of the index, looking into `probes` lists per query.

    With `exact`, lists that the angle bound does not exclude are read in a second pass, and the result is that of a
    full scan. More than a block of queries are searched block by block.
    """
    q, _, schema = _sides(queries, index.rows.withColumn("deleted_at", F.lit(None).cast("timestamp")))

    def searched(block: pd.DataFrame):
        unit = _unit(block["embedding"]) if len(block) else np.zeros((0, index.centres.shape[1]))
        fine = np.isfinite(unit).all(axis=1)
        block, unit = block[fine].reset_index(drop=True), unit[fine]
        if not len(block) or not len(index.centres):
            return _search(index, block.iloc[:0], np.zeros((0, len(index.centres)), bool), k, schema)
        wanted = _probes(index, unit, probes)
        if exact:
            found, sent = _search(index, block, wanted, k, schema)
            # The k-th similarity per query of the block; fewer than k rows exclude nothing.
            kth = _merged(found, k).filter(F.col("rank") == k - 1).select("qid", "similarity").toPandas().set_index("qid")["similarity"]
            sent.destroy()
            wanted |= can_hold_better(index, unit, block["qid"].map(kth).fillna(-np.inf).to_numpy(float))
        return _search(index, block, wanted, k, schema)

    block = collect_within(q, max_block_queries)
    return _merged(searched(block)[0], k) if block is not None else _by_blocks(q, max_block_queries, searched, k)


def compared_share(queries: DataFrame, index: VectorIndex, probes: int) -> float:
    """Share of the rows an average query is compared with."""
    unit = _unit(queries.filter(F.col("embedding").isNotNull()).select("embedding").toPandas()["embedding"])
    return float((_probes(index, unit, probes) @ index.sizes).mean() / max(1, index.sizes.sum()))
