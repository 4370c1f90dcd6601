import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from subventa.operators.activity import request_rates
from subventa.operators.sessions import fold_sessions
from subventa.streaming import folds
from subventa.streaming.folds import request_rate_stream, session_stream, with_state_store

HIT = "identity string, ts timestamp, path string, hit_id long"
EVENT = "session_id string, at timestamp, is_delete boolean, user_id string, query string"


def drained(spark, tmp_path, schema, batches, transform):
    """What the stream gives for these batches, each a micro-batch, with a restart in the middle."""
    spark = with_state_store(spark)
    inbox, out, checkpoint = (str(tmp_path / x) for x in ("inbox", "out", "checkpoint"))
    half = (len(batches) + 1) // 2
    for part in (batches[:half], batches[half:]):
        for rows in part:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        query = (
            transform(stream).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        assert query.exception() is None
    return spark.read.parquet(out)


@pytest.mark.parametrize("order", ["sorted", "shuffled"])
def test_rates_equal_the_batch_operator(spark, tmp_path, order):
    from datetime import datetime, timedelta, timezone

    rng = random.Random(6)
    start = datetime(2026, 3, 1, 12, tzinfo=timezone.utc)
    rows = []
    for i in range(1500):
        who = rng.choice(["busy", "busy", "busy", "b", "c", None])
        at = start + timedelta(milliseconds=rng.randrange(240_000))
        rows.append((who, at, rng.choice(["/x", "/x", "/health"]), i))
    rows.sort(key=lambda r: r[1])
    if order == "shuffled":  # out of order within the delay
        rows.sort(key=lambda r: (r[1] + timedelta(seconds=rng.uniform(0, 8))))
    batches = [rows[i : i + 400] for i in range(0, len(rows), 400)] + [[("end", start + timedelta(hours=1), "/x", -1)]]
    got = drained(spark, tmp_path, HIT, batches, lambda s: request_rate_stream(s, limit=30))
    per_hit = request_rates(spark.createDataFrame(rows, HIT).fillna("-", ["identity"]), ["ts", "hit_id"], limit=30)
    want = per_hit.groupBy("identity", F.date_trunc("second", "ts").alias("second")).agg(
        F.count(F.lit(1)).alias("hits"), F.max("in_window").alias("in_window"), F.sum(F.col("limited").cast("long")).alias("limited")
    )
    got = got.fillna("-", ["identity"]).filter("identity <> 'end'").select(want.columns)
    assert want.filter("limited > 0").count() > 10
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_sessions_equal_the_batch_fold(spark, tmp_path):
    from datetime import datetime, timedelta, timezone

    rng = random.Random(9)
    start = datetime(2026, 3, 1, 12, tzinfo=timezone.utc)
    moments = rng.sample(range(200_000), 700)
    rows = []
    for ms in moments:
        session = rng.choice(["hot", "hot", *"abcdefgh"])
        user = rng.choice([None, None, "u1", "u2"])
        delete = rng.random() < 0.12
        rows.append((session, start + timedelta(milliseconds=ms), delete, user, None if delete else rng.choice([None, "", "first question " * 9, "short"])))
    rows.sort(key=lambda r: r[1] + timedelta(seconds=rng.uniform(0, 8)))
    batches = [rows[i : i + 200] for i in range(0, len(rows), 200)] + [[("end", start + timedelta(hours=1), False, None, None)]]
    batches += [[(None, start + timedelta(hours=2), False, None, None), ("end", None, True, None, None), ("end", start + timedelta(hours=3), True, None, None)]]
    got = drained(spark, tmp_path, EVENT, batches, session_stream)
    newest = got.groupBy("session_id").agg(F.max_by(F.struct("owner_user_id", "title", "is_active", "turns"), "as_of").alias("h")).select("session_id", "h.*")
    events = spark.createDataFrame(rows, EVENT)
    want = fold_sessions(events.filter("not is_delete"), events.filter("is_delete")).headers
    newest = newest.filter("session_id <> 'end'").select(want.columns)
    assert want.count() == 9 and want.filter("owner_user_id not like 'anon-%'").count() > 3
    assert newest.exceptAll(want).count() == 0 and want.exceptAll(newest).count() == 0

class _Handle:
    """A state store in memory, which counts how often a window's seconds are read."""

    def __init__(self):
        self.held, self.timers = {}, []

    def getMapState(self, *_):
        return self

    def exists(self):
        return bool(self.held)

    def iterator(self):
        return iter(list(self.held.items()))

    def clear(self):
        self.held = {}

    def updateValue(self, key, value):
        self.held[key] = value

    def registerTimer(self, at):
        self.timers.append(at)


def test_a_busy_identity_takes_time_by_its_seconds_alone():
    """300,000 seconds with hits in windows of an hour, in two batches: a pass over the window for each would take minutes."""
    fold, handle = folds._Window(3600, 5000), _Handle()
    fold.init(handle)
    seconds = np.arange(300_000)
    begun = time.perf_counter()
    out = []
    for part in np.array_split(seconds, 2):
        shuffled = np.random.default_rng(1).permutation(part)
        out += fold.handleInputRows(("a",), iter([pd.DataFrame({"sec": shuffled, "hits": shuffled % 4})]), None)
    assert time.perf_counter() - begun < 10
    got = pd.concat(out, ignore_index=True)
    hits = seconds % 4
    upto = np.concatenate([np.zeros(3600, int), np.cumsum(hits)])
    total = np.cumsum(hits) - upto[: len(hits)]
    assert (got["hits"] == hits).all() and (got["in_window"] == total).all()
    assert (got["limited"] == np.minimum(hits, np.maximum(0, total - 5000))).all()
    assert (got["second"] == pd.to_datetime(seconds, unit="s", utc=True)).all()
    assert sorted(k for (k,) in handle.held) == list(range(300_000 - 3600, 300_000)) and handle.timers[-1] == (299_999 + 3600) * 1000
