"""The corpus as a table of versions: a base, and the rows each batch changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from subventa.schema import CORPUS
from subventa.sources.deltas import DeltaTable


def corpus_table(spark: SparkSession, root: str, buckets: int = 64) -> DeltaTable:
    return DeltaTable(spark, root, CORPUS, "source_url", buckets)


def latest_version(spark: SparkSession, root: str, below: int | None = None) -> int | None:
    return corpus_table(spark, root).latest(below)


def read_snapshot(spark: SparkSession, root: str, below: int | None = None) -> DataFrame:
    """Newest committed version, or an empty corpus."""
    table = corpus_table(spark, root)
    return table.read() if below is None else table.read_below(below)


def write_snapshot(corpus: DataFrame, root: str, version: int) -> None:
    """A whole corpus as a version of its own; batches append their changes instead."""
    corpus_table(corpus.sparkSession, root).replace(corpus, version)
