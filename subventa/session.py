"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

JOB_CONF = {
    # Deadlines and ledger stamps are UTC everywhere.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call-site capture slows down building the larger expressions.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # One Arrow batch holds page or document texts, so bound it by bytes.
    "spark.sql.execution.arrow.maxBytesPerBatch": "67108864",
}


def build_session(app_name: str = "subventa", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**JOB_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
