import pytest
from pyspark.sql import functions as F

from subventa.operators import corpus as C
from subventa.operators.ingest import run_history
from subventa.schema import CORPUS
from subventa.sources.snapshots import latest_version, read_snapshot, write_snapshot
from subventa.sources.tables import append_runs, read_live_corpus, read_runs


def corpus(spark, n):
    base = spark.range(n).select(
        F.concat(F.lit("g"), "id").alias("grant_id"),
        F.when(F.col("id") % 3 == 0, F.lit("2026-01-01").cast("timestamp")).alias("deleted_at"),
        F.col("id").cast("decimal(14,2)").alias("funding_max_eur"),
        F.lit("kfw").alias("portal"),
    )
    return base.select(
        *[F.col(f.name) if f.name in base.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in CORPUS.fields]
    )


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "corpus")
    assert latest_version(spark, root) is None and read_snapshot(spark, root).count() == 0
    write_snapshot(corpus(spark, 3), root, 1)
    write_snapshot(corpus(spark, 9), root, 2)
    (tmp_path / "corpus" / "version=3").mkdir()  # started, never committed
    assert latest_version(spark, root) == 2 and latest_version(spark, root, below=2) == 1
    assert read_snapshot(spark, root).count() == 9 and read_snapshot(spark, root, below=2).count() == 3
    live = read_live_corpus(spark, f"{root}/version=2")
    assert live.count() == 6
    plan = live.select("grant_id")._jdf.queryExecution().executedPlan().toString()
    assert "IsNull(deleted_at)" in plan and "embedding" not in plan


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = spark.createDataFrame(
        [(f"r{i}", "kfw" if i % 2 else "eic", "success", f"2026-01-0{i + 1} 00:00:00") for i in range(5)],
        "run_id string, portal string, status string, started_at string",
    )
    append_runs(rows.filter("run_id < 'r3'"), path)
    append_runs(rows.filter("run_id >= 'r3'"), path)
    assert [r["run_id"] for r in run_history(read_runs(spark, path), limit=2).collect()] == ["r4", "r3"]
    assert [r["run_id"] for r in run_history(read_runs(spark, path), "kfw").collect()] == ["r3", "r1"]


def test_paging(spark):
    rows = C.filter_corpus(corpus(spark, 30), portal="kfw", min_funding=5)
    got = [r["grant_id"] for r in C.page(rows, "funding_max", limit=3, offset=1).collect()]
    assert got == ["g28", "g26", "g25"]
    meta = C.page_meta(rows, 3, 16).first()
    assert (meta["total"], meta["returned"]) == (17, 1)
    assert C.point_lookup(corpus(spark, 30), "g3").count() == 0 and C.point_lookup(corpus(spark, 30), "g4").count() == 1
    for bad in ({"limit": 0}, {"limit": 201}, {"offset": -1}, {"sort": "title"}):
        with pytest.raises(ValueError):
            C.page(rows, **bad)
    with pytest.raises(ValueError):
        C.filter_condition(colour="red")
