from pyspark.sql import functions as F

from subventa.operators.workflow import ingest_pages
from subventa.plans.extraction import page_portal
from subventa.schema import CORPUS
from subventa.sources.snapshots import latest_version, read_snapshot
from subventa.streaming.ingest import refresh

PAGES = "/root/testdata/sf0.001/pages.parquet"


def test_drained_stream_equals_one_batch(spark, tmp_path):
    pages = spark.read.parquet(PAGES)
    inbox, root = str(tmp_path / "inbox"), str(tmp_path / "store")
    pages.filter("page_id < 20").coalesce(1).write.mode("append").parquet(inbox)
    pages.filter("page_id >= 20 and page_id < 35").coalesce(1).write.mode("append").parquet(inbox)

    def drain():
        query = refresh(spark, inbox, root, page_portal, max_files=1)
        query.awaitTermination()
        assert query.exception() is None

    drain()
    assert latest_version(spark, f"{root}/corpus") == 2
    pages.filter("page_id >= 35").coalesce(1).write.mode("append").parquet(inbox)
    drain()
    drain()  # nothing new: nothing is processed again
    assert latest_version(spark, f"{root}/corpus") == 3

    tagged = pages.withColumn("portal", page_portal(F.col("url")))
    whole = ingest_pages(tagged, spark.createDataFrame([], CORPUS), F.lit("r"), F.current_timestamp())
    columns = ["grant_id", "source_url", "source_hash", "title", "body", "portal", "country"]
    stored = read_snapshot(spark, f"{root}/corpus").select(*columns)
    assert stored.count() > 0 and stored.exceptAll(whole.snapshot.select(*columns)).count() == 0
    assert whole.snapshot.select(*columns).exceptAll(stored).count() == 0
    ledger = spark.read.parquet(f"{root}/ledger").agg(F.sum("inserted"), F.sum("failed")).first()
    assert ledger[0] == stored.count() and ledger[0] + ledger[1] == pages.count()
    closed = spark.read.parquet(f"{root}/ledger").filter("finished_at > started_at and duration_ms >= 0 and error is null")
    assert closed.count() == spark.read.parquet(f"{root}/ledger").count()
    # the same pages as a new batch change nothing
    again = ingest_pages(tagged, read_snapshot(spark, f"{root}/corpus"), F.lit("r"), F.current_timestamp())
    assert {r["action"] for r in again.outcomes.select("action").distinct().collect()} <= {"skipped_unchanged", "failed"}


def test_failed_run_leaves_a_ledger_row(spark, tmp_path):
    inbox, root = str(tmp_path / "inbox"), str(tmp_path / "store")
    spark.read.parquet(PAGES).limit(3).write.parquet(inbox)
    query = refresh(spark, inbox, root, lambda url: F.raise_error(F.lit("portal map is down")).cast("string"))
    try:
        query.awaitTermination()
    except Exception as error:
        assert "portal map is down" in str(error)
    row = spark.read.parquet(f"{root}/ledger").first()
    assert row.status == "failed" and "portal map is down" in row.error and row.error_type and row.finished_at > row.started_at
