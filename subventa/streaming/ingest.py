"""Incremental ingest over arriving page files.

One query drains what has arrived and stops (availableNow), so runs never
overlap and missed runs coalesce. Every micro-batch appends the rows it changes
as the version named by its batch id, on top of the version before it; a batch
that is replayed after a failure writes the same version again. Of the stored
corpus it reads the buckets of the arriving urls. After `MAX_DELTAS` appends the
deltas are compacted into a new base.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from subventa.operators.extract import extract_records, with_rejections
from subventa.operators.workflow import ingest_pages
from subventa.schema import PAGE
from subventa.sources.snapshots import corpus_table
from subventa.sources.tables import RUN_LEDGER

# Deltas a reader has to merge at most.
MAX_DELTAS = 16


def page_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(PAGE)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def refresh(
    spark: SparkSession,
    pages_path: str,
    root: str,
    portal: Callable[[Column], Column],
    max_files: int | None = None,
    max_deltas: int = MAX_DELTAS,
) -> StreamingQuery:
    """Start one draining run; `portal` maps a page url to its portal.

    Below `root`: corpus (a delta table), ledger/batch=N, records/batch=N, rejects/batch=N, checkpoint.
    """

    def batch(pages: DataFrame, batch_id: int) -> None:
        session = pages.sparkSession
        version = batch_id + 1
        # The driver's clock: an expression would be evaluated anew by every action.
        began = datetime.now(timezone.utc)
        started = F.lit(began)

        def close(ledger: DataFrame) -> None:
            ended = datetime.now(timezone.utc)
            filled = ledger.withColumns(
                {
                    "trigger": F.lit("scheduled"),
                    "started_at": started,
                    "finished_at": F.lit(ended),
                    "duration_ms": F.lit(int((ended - began).total_seconds() * 1000)),
                    "embedded": F.lit(False),
                }
            )
            columns = [
                F.col(f.name).cast(f.dataType) if f.name in filled.columns else F.lit(None).cast(f.dataType).alias(f.name)
                for f in RUN_LEDGER.fields
            ]
            filled.select(*columns).write.mode("overwrite").parquet(f"{root}/ledger/batch={batch_id}")

        try:
            tagged = pages.withColumn("portal", portal(F.col("url")))
            # Parsed once and stored: the ledger and the snapshot both read it.
            records = f"{root}/records/batch={batch_id}"
            with_rejections(extract_records(tagged)).write.mode("overwrite").parquet(records)
            checked = session.read.parquet(records)
            corpus = corpus_table(session, f"{root}/corpus")
            target = corpus.lookup(checked.filter("source_url is not null"), below=version)
            run = ingest_pages(tagged, target, F.lit(f"batch-{batch_id}"), started, checked)
            run.rejects.write.mode("overwrite").parquet(f"{root}/rejects/batch={batch_id}")
            written = corpus.append(run.changes, version)
            close(run.ledger)
            if len(written.deltas) > max_deltas:
                corpus.compact()
        except Exception as error:
            failed = session.createDataFrame(
                [(f"batch-{batch_id}", "failed", 0, 0, 0, 0, str(error), type(error).__name__)],
                "run_id string, status string, inserted long, updated long, skipped_unchanged long, failed long, error string, error_type string",
            )
            close(failed)
            raise

    return (
        page_stream(spark, pages_path, max_files)
        .writeStream.foreachBatch(batch)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
