from datetime import datetime

from pyspark.sql import functions as F

from subventa.operators import embed as M
from subventa.operators import ingest as I
from subventa.operators.order import blocked_lag, blocked_rank, top_per_key
from subventa.operators.workflow import arrivals_of
from subventa.schema import CORPUS

NOW = "2026-02-01 00:00:00"


def record(arrival, url, title="Title", body="Body", **more):
    row = {
        "page_id": arrival, "portal": "exist", "source_url": url, "source_doc_id": "abc", "title": title, "summary": "Summary",
        "body": body, "status": "open", "country": "DE", "federal_state": None, "funding_min_eur": 2500.0,
        "funding_max_eur": 30000.0, "deadline": datetime(2026, 12, 31), "sector": None,
    }
    row.update(more)
    return row


SCHEMA = (
    "page_id long, portal string, source_url string, source_doc_id string, title string, summary string, body string, status string, "
    "country string, federal_state string, funding_min_eur double, funding_max_eur double, deadline timestamp, sector string"
)


def batch(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    money = {c: F.col(c).cast("decimal(38,6)") for c in ("funding_min_eur", "funding_max_eur")}
    return arrivals_of(df.withColumns(money))


def now():
    return F.lit(NOW).cast("timestamp")


def test_insert_skip_update(spark):
    empty = spark.createDataFrame([], CORPUS)
    first = batch(spark, [record(1, "https://example.test/a")])
    assert [r["action"] for r in I.classify_arrivals(first, empty).collect()] == [I.INSERTED]
    snapshot = I.upsert_snapshot(empty, first, now())
    row = snapshot.first()
    assert len(row["source_hash"]) == 64 and row["embedding"] is None and row["created_at"] == datetime(2026, 2, 1)
    assert [r["action"] for r in I.classify_arrivals(first, snapshot).collect()] == [I.SKIPPED]
    changed = batch(spark, [record(1, "https://example.test/a", title="New")])
    assert [r["action"] for r in I.classify_arrivals(changed, snapshot).collect()] == [I.UPDATED]
    vectors = changed.select("source_hash", F.array(F.lit(1.0)).alias("embedding"))
    later = F.lit("2026-03-01 00:00:00").cast("timestamp")
    after = I.upsert_snapshot(snapshot, changed, later, vectors).first()
    assert (after["title"], after["grant_id"], after["embedding"]) == ("New", row["grant_id"], [1.0])
    assert after["created_at"] == datetime(2026, 2, 1) and after["updated_at"] == datetime(2026, 3, 1)
    # the same text again without an embedder leaves everything, with new text the vector is cleared
    again = I.upsert_snapshot(snapshot, batch(spark, [record(1, "https://example.test/a", title="Newer")]), later).first()
    assert again["embedding"] is None


def test_volatile_columns(spark):
    empty = spark.createDataFrame([], CORPUS)
    snapshot = I.upsert_snapshot(empty, batch(spark, [record(1, "https://example.test/a")]), now())
    moved = batch(spark, [record(1, "https://example.test/a", deadline=datetime(2027, 1, 1))])
    kept = I.upsert_snapshot(snapshot, moved, now()).first()
    assert kept["deadline"] == datetime(2026, 12, 31)
    fresh = I.upsert_snapshot(snapshot, moved, now(), refresh_volatile=True).first()
    assert fresh["deadline"] == datetime(2027, 1, 1)


def test_repeats_inside_a_batch(spark):
    empty = spark.createDataFrame([], CORPUS)
    url = "https://example.test/hot"
    bodies = ["a", "a", "b", "b", "a", "c"]
    rows = [record(i * 7, url, body=b) for i, b in enumerate(bodies)] + [record(3, "https://example.test/other")]
    got = I.classify_arrivals(batch(spark, rows), empty, arrivals_per_block=10).filter(F.col("source_url") == url)
    actions = [r["action"] for r in got.orderBy("arrival").collect()]
    assert actions == [I.INSERTED, I.SKIPPED, I.UPDATED, I.SKIPPED, I.UPDATED, I.UPDATED]
    assert I.upsert_snapshot(empty, batch(spark, rows), now()).filter(F.col("source_url") == url).first()["body"] == "c"


def test_run_status(spark):
    rows = [("r1", "kfw", a) for a in (I.INSERTED, I.FAILED)] + [("r2", "kfw", I.FAILED)] + [("r3", "kfw", I.SKIPPED)]
    runs = I.with_run_status(I.run_counters(spark.createDataFrame(rows, "run_id string, portal string, action string")))
    assert {r["run_id"]: r["status"] for r in runs.collect()} == {"r1": "partial", "r2": "failed", "r3": "success"}


def test_blocked_helpers_equal_plain_windows(spark):
    import random

    rnd = random.Random(5)
    rows = [(rnd.choice("aab"), i, rnd.choice(["x", "y"])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i long, v string")
    lag = {r["i"]: r["p"] for r in blocked_lag(df, ["k"], ["i"], "v", F.floor(F.col("i") / 13), "p").collect()}
    rank = {r["i"]: r["n"] for r in blocked_rank(df, ["k"], [F.col("i")], F.floor(F.col("i") / 13), "n").collect()}
    seen, count = {}, {}
    for k, i, v in rows:
        assert lag[i] == seen.get(k) and rank[i] == count.get(k, 0)
        seen[k], count[k] = v, count.get(k, 0) + 1


def test_skew_join_and_top(spark):
    big = spark.range(1000).withColumn("k", F.when(F.col("id") < 700, 1).otherwise(F.col("id") % 7))
    top = top_per_key(big, ["k"], [F.desc("id")], 2)
    assert {(r["k"], r["rank"]): r["id"] for r in top.collect()}[(1, 0)] == 995


def test_backfill_calls_the_model_once_per_text(spark):
    rows = [(1, "query: a"), (2, "passage: a"), (3, "a"), (4, "b"), (5, "b")]
    texts = spark.createDataFrame(rows, "id int, text string")
    store = M.run_model(M.task_rows(texts.filter("id = 4")), M.hashed_trigram_embedder(8))
    filled, new = M.backfill(texts, store, M.hashed_trigram_embedder(8))
    assert new.count() == 2  # query a and document a; b is stored
    vectors = {r["id"]: r["embedding"] for r in filled.collect()}
    assert vectors[2] == vectors[3] and vectors[4] == vectors[5] and None not in vectors.values()
    totals = M.embed_totals(filled).first()
    assert (totals["embedded"], totals["failed"]) == (5, 0)


def test_failing_texts_are_counted_one_by_one(spark):
    plain = M.hashed_trigram_embedder()

    def picky(texts, tasks):
        if texts.str.contains("bad").any():
            raise ValueError("model refuses")
        return plain(texts, tasks)

    texts = spark.createDataFrame([(i, "bad text" if i % 7 == 0 else f"text {i}") for i in range(50)], "doc_id int, text string").coalesce(1)
    store = spark.createDataFrame([], "key string, embedding array<float>")
    filled, new = M.backfill(texts, store, picky)
    assert {r.doc_id for r in filled.filter("embedding is null").collect()} == set(range(0, 50, 7))
    assert new.count() == 42 and M.embed_totals(filled).first()["failed"] == 8
