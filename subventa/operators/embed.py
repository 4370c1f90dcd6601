"""Embedding backfill with a content-addressed store and a pluggable model."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subventa.functions.text import embedding_key, embedding_task, embedding_text, without_task_prefix
from subventa.functions.vectors import l2_normalise
from subventa.operators.bounds import spread_small
from subventa.sources.deltas import DeltaTable
from subventa.sources.shared import shared_path, stored

# Texts per model call (fixed value).
MODEL_BATCH = 32
# Faults of the way to a model, not of a text: such a call is tried again, and then fails the task.
TRANSIENT = (OSError, TimeoutError)
TRIES, PAUSE = 3, 0.5

VECTORS = T.StructType([T.StructField("key", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])

EmbedFn = Callable[[pd.Series, pd.Series], list]


def hashed_trigram_embedder(dim: int = 64) -> EmbedFn:
    """Deterministic stand-in for a hosted model: hashed character trigrams."""

    def embed(texts: pd.Series, tasks: pd.Series) -> list:
        out = np.zeros((len(texts), dim), dtype=np.float64)
        for row, text in enumerate(texts):
            points = np.frombuffer(f"  {text.lower()} ".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
            h = (points[:-2] * 961 + points[1:-1] * 31 + points[2:]) * 2654435761 % (1 << 32)
            signs = np.where((h >> np.uint64(16)) & np.uint64(1), 1.0, -1.0)
            out[row] = np.bincount((h % dim).astype(np.int64), weights=signs, minlength=dim)
        return list(out)

    return embed


def task_rows(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds task, bare text and store key."""
    tasked = texts.withColumn("task", embedding_task(F.col(text_col))).withColumn(
        "bare_text", without_task_prefix(F.col(text_col))
    )
    return tasked.withColumn("key", embedding_key(F.col("task"), F.col("bare_text")))


def run_model(keyed: DataFrame, embed_fn: EmbedFn, max_tasks: int | None = None) -> DataFrame:
    """(key, task, bare_text) to (key, embedding), 32 texts per call.

    `max_tasks` bounds how many calls run at once against a shared model. A call
    that meets a lost connection or a time limit is tried again and then fails its
    task, which Spark repeats. A call that the model refuses is repeated text by
    text; a text that is refused alone gets a null embedding, which counts as
    failed and stays missing in the store.
    """

    def called(texts: pd.Series, tasks: pd.Series) -> list:
        for left in range(TRIES - 1, -1, -1):
            try:
                return embed_fn(texts, tasks)
            except TRANSIENT:
                if not left:
                    raise
                time.sleep(PAUSE)

    def vectors_of(texts: pd.Series, tasks: pd.Series) -> list:
        vectors = called(texts, tasks)
        if len(vectors) != len(texts):
            raise RuntimeError(f"model returned {len(vectors)} vectors for {len(texts)} texts")
        return [list(map(float, v)) for v in vectors]

    def one_by_one(texts: pd.Series, tasks: pd.Series) -> list:
        out = []
        for i in range(len(texts)):
            try:
                out += vectors_of(texts.iloc[i : i + 1].reset_index(drop=True), tasks.iloc[i : i + 1].reset_index(drop=True))
            except TRANSIENT:
                raise
            except Exception:  # counted by embed_totals
                out.append(None)
        return out

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), MODEL_BATCH):
                part = batch.iloc[start : start + MODEL_BATCH]
                texts, tasks = part["bare_text"].reset_index(drop=True), part["task"].reset_index(drop=True)
                try:
                    vectors = vectors_of(texts, tasks)
                except TRANSIENT:
                    raise
                except Exception:
                    vectors = one_by_one(texts, tasks)
                yield pd.DataFrame({"key": part["key"].values, "embedding": vectors})

    rows = keyed.select("key", "task", "bare_text")
    rows = spread_small(rows) if max_tasks is None else rows.repartition(max_tasks, "key")
    raw = rows.mapInPandas(call, "key string, embedding array<double>")
    return raw.select("key", l2_normalise(F.col("embedding")).cast("array<float>").alias("embedding"))


def missing_embeddings(keyed: DataFrame, store: DataFrame) -> DataFrame:
    """Distinct texts the store lacks."""
    return keyed.select("key", "task", "bare_text").dropDuplicates(["key"]).join(
        store.select("key"), "key", "left_anti"
    )


def backfill(
    texts: DataFrame, store: DataFrame, embed_fn: EmbedFn, text_col: str = "text", max_tasks: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(texts with embedding, rows to append to the store).

    Write the second frame to the store before reading the first where the
    model is costly, so that it is called once per text.
    """
    keyed = task_rows(texts, text_col)
    new = run_model(missing_embeddings(keyed, store), embed_fn, max_tasks)
    vectors = store.select("key", "embedding").unionByName(new)
    return keyed.join(vectors, "key", "left"), new.filter(F.col("embedding").isNotNull())


# --- vectors on storage ---------------------------------------------------------------


@dataclass(frozen=True)
class Written:
    """Texts the model was asked for, vectors stored, and corpus rows written."""

    asked: int
    embedded: int
    rows: int


def vector_store(spark: SparkSession, root: str, buckets: int = 64) -> DeltaTable:
    """Vectors by content key, in buckets of the key."""
    return DeltaTable(spark, root, VECTORS, "key", buckets)


def embed_into(texts: DataFrame, store: DeltaTable, embed_fn: EmbedFn, text_col: str = "text", again: bool = False, max_tasks: int | None = None) -> Written:
    """Ask the model for the texts the store lacks (with `again` for all of them) and append the vectors.

    The vectors are written before anything reads them, so the model sees a text once. Only the buckets of the
    texts' keys are read. A text that the model refuses stays missing.
    """
    keyed = task_rows(texts, text_col).select("key", "task", "bare_text").dropDuplicates(["key"])
    due = keyed if again else keyed.join(store.lookup(keyed).select("key"), "key", "left_anti")
    spark = store.spark
    due = stored(due, shared_path(spark, "due"))
    asked = due.count()
    if not asked:
        return Written(0, 0, 0)
    made = run_model(due, embed_fn, max_tasks).filter(F.col("embedding").isNotNull())
    return Written(asked, store.append(made, (store.latest() or 0) + 1).rows, 0)


def with_vectors(texts: DataFrame, store: DeltaTable, text_col: str = "text") -> DataFrame:
    """`texts` with key and the stored embedding, null where there is none."""
    keyed = task_rows(texts, text_col)
    return keyed.join(store.lookup(keyed), "key", "left")


def backfill_corpus(corpus: DeltaTable, store: DeltaTable, embed_fn: EmbedFn, again: bool = False, max_tasks: int | None = None) -> Written:
    """Give live rows without a vector (with `again` all live rows) the vector of their text, as a delta of the corpus.

    Rows of a text that is stored already cost no model call; a row whose text is refused is not written.
    """
    rows = corpus.read().filter(F.col("deleted_at").isNull())
    if not again:
        rows = rows.filter(F.col("embedding").isNull())
    passage = F.concat(F.lit("passage: "), embedding_text(F.col("title"), F.col("summary"), F.col("body")))
    texts = rows.select("source_url", passage.alias("text"))
    asked = embed_into(texts, store, embed_fn, again=again, max_tasks=max_tasks)
    found = with_vectors(texts, store).filter(F.col("embedding").isNotNull()).select("source_url", F.col("embedding").alias("_vector"))
    filled = rows.join(found, "source_url").withColumn("embedding", F.col("_vector")).drop("_vector")
    written = corpus.append(filled, (corpus.latest() or 0) + 1)
    return Written(asked.asked, asked.embedded, written.rows)


def re_embed(corpus: DataFrame, embed_fn: EmbedFn, limit: int | None = None, max_tasks: int | None = None) -> DataFrame:
    """Fresh vectors for all live rows, store ignored; equal texts are embedded once."""
    live = corpus.filter(F.col("deleted_at").isNull())
    if limit is not None:
        live = live.orderBy("grant_id").limit(limit)
    passage = F.concat(F.lit("passage: "), embedding_text(F.col("title"), F.col("summary"), F.col("body")))
    keyed = task_rows(live.select("grant_id", passage.alias("text")))
    vectors = run_model(keyed.dropDuplicates(["key"]), embed_fn, max_tasks)
    return keyed.select("grant_id", "key").join(vectors, "key", "left").select("grant_id", "embedding")


def embed_totals(result: DataFrame) -> DataFrame:
    return result.agg(
        F.count_if(F.col("embedding").isNotNull()).alias("embedded"),
        F.count_if(F.col("embedding").isNull()).alias("failed"),
    )
