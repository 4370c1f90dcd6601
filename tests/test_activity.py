import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from subventa.operators import activity as A
from subventa.operators import sessions as S
from subventa.operators import stats
from subventa.schema import CORPUS


def test_rates_equal_a_sliding_log(spark):
    rnd = random.Random(3)
    start = datetime(2026, 1, 1)
    hits = [(i, rnd.choice(["a", "a", "b"]), start + timedelta(seconds=rnd.random() * 900), rnd.choice(["/x", "/health"])) for i in range(600)]
    hits.sort(key=lambda h: (h[2], h[0]))
    df = spark.createDataFrame(hits, "id int, identity string, ts timestamp, path string")
    got = {r["id"]: r for r in A.request_rates(df, ["ts", "id"], limit=15, block_seconds=60).collect()}
    log = {}
    for i, who, ts, path in hits:
        if path == "/health":
            assert i not in got
            continue
        now = int((ts - start).total_seconds())
        kept = [t for t in log.get(who, []) if t > now - 60] + [now]
        log[who] = kept
        assert (got[i]["in_window"], got[i]["limited"]) == (len(kept), len(kept) > 15)


def test_searches(spark):
    rows = [("u", i, q) for i, q in enumerate(["a", " A ", "b", "", "  ", "c", "d", "e", "f", "g", "h", "i", "B"])]
    got = A.recent_searches(spark.createDataFrame(rows, "user_id string, n int, query string"), ["n"])
    assert [r["query"] for r in got.orderBy("rank").collect()] == ["B", "i", "h", "g", "f", "e", "d", "c"]


def test_saved_items(spark):
    log = [("toggle", 1), ("toggle", 2), ("toggle", 1), ("toggle", 3), ("remove", 3), ("toggle", 4), ("clear", None), ("toggle", 2), ("toggle", 5), ("remove", 5), ("toggle", 5)]
    df = spark.createDataFrame([("u", i, a, k) for i, (a, k) in enumerate(log)], "user_id string, n int, a string, item_id int")
    got = {r["item_id"]: r["n"] for r in A.saved_items(df, ["n"], F.col("a")).collect()}
    assert got == {2: 7, 5: 10}


def test_sessions(spark):
    turns = [
        ("s1", 1, None, "first question"), ("s1", 3, "u1", "second"), ("s1", 6, "u2", "third"),
        ("s2", 1, None, ""), ("s2", 2, None, "x" * 100), ("s3", 1, "u3", "gone"),
    ]
    deletes = [("s1", 2, None), ("s1", 5, "u2"), ("s3", 4, "u3"), ("s4", 1, None), ("s2", 0, None)]
    folded = S.fold_sessions(
        spark.createDataFrame(turns, "session_id string, at long, user_id string, query string"),
        spark.createDataFrame(deletes, "session_id string, at long, user_id string"),
        block=F.floor(F.col("at") / 2),
    )
    heads = {r["session_id"]: r for r in folded.headers.collect()}
    # the signed-out delete counts, the one by a stranger after the hand-over does not
    assert (heads["s1"]["owner_user_id"], heads["s1"]["turns"], heads["s1"]["title"]) == ("u1", 2, "first question")
    assert (heads["s2"]["owner_user_id"], heads["s2"]["turns"], heads["s2"]["title"]) == ("anon-s2", 2, "x" * 80)
    assert (heads["s3"]["is_active"], heads["s3"]["turns"]) == (False, 0)
    history = {(r["session_id"], r["position"]): r["query"] for r in folded.history.collect()}
    assert history[("s1", 0)] == "second" and history[("s1", 1)] == "third" and ("s3", 0) not in history
    readers = spark.createDataFrame([("s1", None), ("s1", "u1"), ("s1", "u2"), ("s2", None), ("s3", "u3"), ("s9", "u")], "session_id string, reader_id string")
    seen = {(r["session_id"], r["reader_id"]): r["visible"] for r in S.readable(folded.headers, readers).collect()}
    assert seen == {("s1", None): False, ("s1", "u1"): True, ("s1", "u2"): False, ("s2", None): True, ("s3", "u3"): False, ("s9", "u"): False}
    assert S.replay(folded.history, S.readable(folded.headers, readers)).count() == 4


def test_statistics_of_an_empty_corpus(spark):
    empty = spark.createDataFrame([], CORPUS)
    doc = stats.statistics_document(empty).first()
    assert doc["totals"]["total_grants"] == 0 and doc["totals"]["funding_global_avg"] is None
    assert doc["by_portal"] == [] and doc["by_status"] == [] and doc["by_federal_state"] == []
    assert stats.embedded_share(stats.totals(empty)).first()["embedded_pct"] == 0
    assert stats.statistics_json(empty).first()["totals"].startswith('{"total_grants":0,"embedded_grants":0,"funding_global_min":null')


def test_rates_add_no_second_up_twice(spark):
    """A busy identity, a hit each second: the plan has a running sum and no frame that slides over a range."""
    hits = spark.range(4000).select("id", F.lit("a").alias("identity"), F.timestamp_seconds(F.col("id")).alias("ts"), F.lit("/x").alias("path"))
    rated = A.request_rates(hits, ["ts", "id"], window_seconds=1000, block_seconds=1500)
    assert "RangeFrame" not in rated._jdf.queryExecution().toString()
    assert all(r["in_window"] == min(r["id"] + 1, 1000) for r in rated.collect())
