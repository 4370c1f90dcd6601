"""Alerts: new or changed programmes near a standing profile, each told once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subventa.operators.bounds import spread_small
from subventa.operators.dense import DIGITS, _unit, live_vectors
from subventa.operators.query_block import MAX_BLOCK_QUERIES
from subventa.sources.deltas import DeltaTable
from subventa.sources.shared import shared_path, stored

SENT = T.StructType([T.StructField(n, T.StringType()) for n in ("alert_id", "profile_id", "grant_id", "channel")])
# Profiles and rows compared at once.
_STRIPE = 4096


def sent_alerts(spark: SparkSession, root: str, buckets: int = 64) -> DeltaTable:
    """Alerts told so far."""
    return DeltaTable(spark, root, SENT, "alert_id", buckets)


def near_pairs(profiles: DataFrame, rows: DataFrame, threshold: float, block: int = MAX_BLOCK_QUERIES) -> DataFrame:
    """(profile_id, grant_id, similarity) of all pairs of at least `threshold`; rows are live ones with a vector.

    Profiles are dealt into blocks of about `block`, sent to the tasks one after the other; the rows are scanned for
    each and never shuffled. Every match is written, none is capped.
    """
    spark = profiles.sparkSession
    asked = profiles.filter(F.col("embedding").isNotNull()).select("profile_id", "embedding")
    blocks = max(1, -(-asked.count() // block))
    dealt = stored(asked.withColumn("_block", F.pmod(F.xxhash64("profile_id"), F.lit(blocks))), shared_path(spark, "profiles"))
    near = live_vectors(rows).select("grant_id", "embedding")
    schema = T.StructType([asked.schema["profile_id"], near.schema["grant_id"], T.StructField("similarity", T.DoubleType())])
    out = shared_path(spark, "near")
    for i in range(blocks):
        sent = spark.sparkContext.broadcast(dealt.filter(F.col("_block") == i).toPandas())

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            if sent.value.empty:
                return
            ids, unit = sent.value["profile_id"].to_numpy(), _unit(sent.value["embedding"])
            for batch in batches:
                for start in range(0, len(batch), _STRIPE):
                    part = batch.iloc[start : start + _STRIPE]
                    vectors = _unit(part["embedding"])
                    for first in range(0, len(ids), _STRIPE):
                        sims = np.round(unit[first : first + _STRIPE] @ vectors.T, DIGITS)
                        p, g = np.nonzero(sims >= threshold)
                        yield pd.DataFrame({"profile_id": ids[first + p], "grant_id": part["grant_id"].to_numpy()[g], "similarity": sims[p, g]})

        spread_small(near).mapInPandas(scan, schema).write.mode("overwrite").parquet(f"{out}/block={i}")
        sent.destroy()
    return spark.read.schema(schema).parquet(*[f"{out}/block={i}" for i in range(blocks)])


def new_alerts(profiles: DataFrame, changes: DataFrame, sent: DeltaTable, threshold: float, channel: str = "email") -> DataFrame:
    """alert_id, profile_id, grant_id, channel, similarity of the pairs nobody was told of, which are noted as told.

    `changes` are the rows a batch wrote. A second run over the same rows gives nothing; ids are compared as texts.
    """
    spark = profiles.sparkSession
    pairs = near_pairs(profiles, changes, threshold).withColumn("channel", F.lit(channel))
    # A length before the id keeps apart ids that hold the mark.
    named = F.concat_ws("|", F.length(F.col("profile_id").cast("string")), F.col("profile_id").cast("string"), F.col("grant_id").cast("string"), "channel")
    pairs = pairs.dropDuplicates(["profile_id", "grant_id"]).withColumn("alert_id", F.sha2(named, 256))
    pairs = stored(pairs, shared_path(spark, "alerts"))
    fresh = stored(pairs.join(sent.lookup(pairs).select("alert_id"), "alert_id", "left_anti"), shared_path(spark, "alerts"))
    sent.append(fresh, (sent.latest() or 0) + 1)
    return fresh.select("alert_id", "profile_id", "grant_id", "channel", "similarity")
