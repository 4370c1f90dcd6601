import random

import pytest
from pyspark.sql import functions as F

from subventa.operators.ingest import last_arrivals
from subventa.plans.extraction import page_portal
from subventa.schema import CORPUS
from subventa.sources.deltas import DeltaTable
from subventa.sources.snapshots import corpus_table, read_snapshot
from subventa.streaming.ingest import refresh

PAGES = "/root/testdata/sf0.01/pages.parquet"


def table(spark, root, buckets=8):
    return DeltaTable(spark, root, spark.createDataFrame([], "k string, v long, s string").schema, "k", buckets)


def rows(spark, model):
    return spark.createDataFrame([(k, v, None if v % 5 == 0 else f"s{v}") for k, v in model.items()], "k string, v long, s string")


def content(df):
    return {r.k: (r.v, r.s) for r in df.collect()}


def test_versions_equal_a_plain_dictionary(spark, tmp_path):
    rnd = random.Random(4)
    store, model, known = table(spark, str(tmp_path)), {}, {}
    assert store.latest() is None and store.read().count() == 0 and store.lookup(rows(spark, {"a": 1})).count() == 0
    for version in range(1, 8):
        batch = {f"k{rnd.randrange(60)}": rnd.randrange(1000) for _ in range(rnd.choice([0, 1, 20]))}
        model.update(batch)
        assert store.append(rows(spark, batch), version).rows == len(batch)
        if version in (3, 6):
            before = content(store.read())
            compacted = store.compact(buckets=8 if version == 3 else 5)
            assert compacted.deltas == () and content(store.read()) == before
        known[version] = dict(model)
    for version, wanted in known.items():
        got = store.read(version)
        assert {k: v for k, (v, _) in content(got).items()} == wanted and got.count() == len(wanted)
    some = rows(spark, {"k1": 0, "k2": 0, "absent": 0})
    assert {k: v for k, (v, _) in content(store.lookup(some)).items()} == {k: model[k] for k in ("k1", "k2") if k in model}


def test_a_version_written_again_is_the_same(spark, tmp_path):
    store = table(spark, str(tmp_path))
    store.replace(rows(spark, {f"k{i}": i for i in range(40)}), 1)
    for _ in range(2):
        changes = store.lookup(rows(spark, {"k3": 0}), below=2).withColumn("v", F.col("v") + 100)
        assert store.append(changes, 2).rows == 1
        assert content(store.read())["k3"][0] == 103
    store.compact()
    assert store.append(changes, 2).rows == 1 and content(store.read())["k3"][0] == 103
    assert store.manifest(2).base == 2  # the compacted form still holds
    with pytest.raises(ValueError):
        store.manifest(9)


def test_a_lookup_opens_the_buckets_of_its_keys(spark, tmp_path):
    store = table(spark, str(tmp_path), buckets=16)
    store.replace(rows(spark, {f"k{i}": i for i in range(2000)}), 1)
    store.append(rows(spark, {"k7": -7}), 2)
    found = store.lookup(rows(spark, {"k7": 0}))
    assert content(found) == {"k7": (-7, "s-7")}
    scans = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line]
    assert scans and all("PartitionFilters: [bucket" in line or "bucket#" in line.split("PartitionFilters: [")[1].split("]")[0] for line in scans)


def test_expired_versions_go_and_the_rest_reads(spark, tmp_path):
    store = table(spark, str(tmp_path))
    for version in range(1, 6):
        store.append(rows(spark, {f"k{version}": version, "all": version}), version)
    store.compact()
    store.append(rows(spark, {"all": 6}), 6)
    store._write(rows(spark, {"all": 99}), "delta", 7, 8)  # a batch that has not committed
    wanted = content(store.read())
    gone = store.expire(keep=2)
    assert {"delta/version=1", "manifest/version=5"} <= set(gone) and "delta/version=7" not in gone
    assert store.versions() == [5, 6] and content(store.read()) == wanted and content(store.read(5))["all"][0] == 5
    assert store.expire(keep=2) == []


def test_a_ten_page_batch_writes_its_rows_alone(spark, tmp_path):
    pages = spark.read.parquet(PAGES).filter("url not like '%spam-farm%'")
    inbox, root = str(tmp_path / "inbox"), str(tmp_path / "store")

    def drain():
        query = refresh(spark, inbox, root, page_portal, max_files=1, max_deltas=1)
        query.awaitTermination()
        assert query.exception() is None

    pages.coalesce(1).write.mode("append").parquet(inbox)
    drain()
    corpus = corpus_table(spark, f"{root}/corpus")
    first = read_snapshot(spark, f"{root}/corpus")
    size = first.count()
    urls = [r[0] for r in first.orderBy("source_url").select("source_url").limit(5).collect()]
    assert corpus.manifest(1).rows == size
    ten = pages.orderBy("page_id").limit(10).withColumn("html", F.regexp_replace("html", "</article>", " more</article>"))
    ten.coalesce(1).write.mode("append").parquet(inbox)
    drain()
    touched = ten.select("url").distinct().count()
    written = corpus.spark.read.parquet(f"{root}/corpus/delta/version=2").count()
    assert 0 < written <= touched
    assert corpus.manifest(2).deltas == () and read_snapshot(spark, f"{root}/corpus").count() == size  # compacted after the second delta
    assert read_snapshot(spark, f"{root}/corpus", below=2).count() == size
    assert len(urls) == 5


def test_last_arrival_of_a_url(spark):
    same = [("u", 1, "h1", "a"), ("u", 3, "h2", "b"), ("u", 3, "h2", "b"), ("u", 2, "h3", "c"), ("w", 1, "h", "d")]
    df = spark.createDataFrame(same, "source_url string, arrival long, source_hash string, body string")
    assert sorted(tuple(r) for r in last_arrivals(df).select("source_url", "source_hash", "body").collect()) == [("u", "h2", "b"), ("w", "h", "d")]
