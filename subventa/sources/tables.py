"""Readers and writers for the corpus, pages, gold sets, ledger and evaluation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subventa.schema import CORPUS, EVAL_ROW, GOLD_QUERY, PAGE, RUN_LEDGER


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORPUS).parquet(path)


def read_live_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Live rows; the null test reaches the parquet scan."""
    return read_corpus(spark, path).filter(F.col("deleted_at").isNull())


def read_corpus_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Corpus rows from a relational source, read only. Give partitionColumn and bounds to read in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE).parquet(path)


def read_gold_set(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines are skipped, `relevant` and `rationale` may be missing.

    A broken line, or one without another field, fails the read: a gold set that
    loses queries would shift every mean.
    """
    rows = spark.read.schema(GOLD_QUERY).option("mode", "FAILFAST").json(path)
    empty = F.array().cast("array<string>")

    def required(name: str):
        return F.coalesce(F.col(name), F.raise_error(F.lit(f"gold query without {name}")).cast(GOLD_QUERY[name].dataType))

    needed = [f.name for f in GOLD_QUERY.fields if f.name not in ("relevant", "rationale")]
    return rows.withColumns(
        {n: required(n) for n in needed} | {"relevant": F.coalesce("relevant", empty), "rationale": F.coalesce("rationale", F.lit(""))}
    )


def read_eval_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL_ROW).json(path)


def write_eval_rows(rows: DataFrame, path: str) -> None:
    """One JSON line per (query, configuration)."""
    rows.write.mode("append").json(path)


def append_runs(runs: DataFrame, path: str) -> None:
    """Finished ledger rows; a run is written once, closed."""
    casts = [F.col(f.name).cast(f.dataType) if f.name in runs.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in RUN_LEDGER.fields]
    runs.select(*casts).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_LEDGER).parquet(path)
