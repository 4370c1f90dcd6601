"""Request rates and session folds over streams of events.

Both wait for the watermark before they judge: an event counts at its own time,
whatever the order of arrival, and results equal those of the batch operators
over the same events. Events behind the watermark are dropped, as by any Spark
stream; `delay` says how long to wait.

* Rates: hits are first summed per identity and second by a windowed aggregation
  (combined before the shuffle, so a busy identity travels as one row a task and
  second). State of an identity are the seconds of one rate window.
* Sessions: events wait in the state of their session until the watermark has
  passed them and are then folded in the order of their times. State is one
  header row and the events of the last `delay`.

State lies in the store of `spark.sql.streaming.stateStore.providerClass`, which
has to be the RocksDB one (`with_state_store`), and is checkpointed with the query.

Defined cases: hits without identity are an identity of their own; without time
they are left out, as are events of no session or time. Repeated hits count as
often as they come; repeated session events count once per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from subventa.operators.activity import BURST, HEALTH_PATHS, PER_MINUTE, WINDOW_SECONDS
from subventa.operators.sessions import ANON_PREFIX, TITLE_CHARS

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Rows of a frame handed back.
_OUT_ROWS = 100_000
RATES = "identity string, second timestamp, hits long, in_window long, limited long"
HEADERS = "session_id string, as_of timestamp, owner_user_id string, title string, is_active boolean, turns long"


def with_state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    return spark


class _Window(StatefulProcessor):
    """Hits of the seconds of one rate window before the second at hand."""

    def __init__(self, window_seconds: int, limit: int):
        self.window_seconds, self.limit = window_seconds, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seconds = handle.getMapState("seconds", "second long", "hits long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat([part[["sec", "hits"]] for part in rows]).groupby("sec")["hits"].sum().sort_index()
        kept = {k[0]: v[0] for k, v in self.seconds.iterator()} if self.seconds.exists() else {}
        known = pd.concat([pd.Series(kept, dtype="int64"), fresh]).groupby(level=0).last().sort_index()
        secs, hits = known.index.to_numpy(dtype="int64"), known.to_numpy(dtype="int64")
        # Sums over the windows from one running sum, whatever the number of seconds in a window.
        upto = np.concatenate([[0], np.cumsum(hits)])
        total = upto[1:] - upto[np.searchsorted(secs, secs - self.window_seconds, "right")]
        own = np.isin(secs, fresh.index.to_numpy(dtype="int64"))
        last = int(secs[own][-1])
        self.seconds.clear()
        held = secs > last - self.window_seconds
        for sec, n in zip(secs[held].tolist(), hits[held].tolist()):
            self.seconds.updateValue((sec,), (n,))
        # Once the window has passed, an idle identity needs no state.
        self.handle.registerTimer((int(secs[-1]) + self.window_seconds) * 1000)
        secs, hits, total = secs[own], hits[own], total[own]
        limited = np.minimum(hits, np.maximum(0, total - self.limit))
        for start in range(0, len(secs), _OUT_ROWS):
            cut = slice(start, start + _OUT_ROWS)
            second = pd.to_datetime(secs[cut], unit="s", utc=True)
            yield pd.DataFrame({"identity": pd.Series([key[0]] * len(second), dtype=object), "second": second, "hits": hits[cut], "in_window": total[cut], "limited": limited[cut]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        for (sec,) in [k for k in self.seconds.keys()]:
            if sec <= now - self.window_seconds:
                self.seconds.removeKey((sec,))
        yield pd.DataFrame(columns=["identity", "second", "hits", "in_window", "limited"])

    def close(self) -> None:
        pass


def request_rate_stream(
    hits: DataFrame,
    delay: str = "10 seconds",
    window_seconds: int = WINDOW_SECONDS,
    limit: int = PER_MINUTE + BURST,
    exempt: tuple[str, ...] = HEALTH_PATHS,
) -> DataFrame:
    """One row per identity and second with hits: how many, how many lie in the window that ends with it, how many of its hits are over the limit.

    `hits`: a stream with identity, ts, path. Rejected hits count, unmetered paths do not.
    """
    metered = hits.filter(F.col("ts").isNotNull() & ~F.coalesce(F.col("path"), F.lit("")).isin(*exempt)).withWatermark("ts", delay)
    seconds = metered.groupBy(F.window("ts", "1 second").alias("w"), F.col("identity").cast("string").alias("identity")).agg(F.count(F.lit(1)).alias("hits"))
    timed = seconds.select("identity", F.window_time("w").alias("at"), F.unix_seconds(F.col("w.start")).alias("sec"), "hits")
    return timed.groupBy("identity").transformWithStateInPandas(_Window(window_seconds, limit), RATES, "Append", "EventTime")


class _Fold(StatefulProcessor):
    """Header of a session, and its events that the watermark has not passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.header = handle.getValueState("header", "owner string, title string, started boolean, turns long")
        self.waiting = handle.getListState("waiting", "micros long, is_delete boolean, user_id string, query string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            part = part.astype(object).where(part.notna(), None)
            events = [(int(m), bool(d), u, q) for m, d, u, q in zip(part["micros"], part["is_delete"], part["user_id"], part["query"])]
            self.waiting.appendList(events)
            least = min(e[0] for e in events)
            first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        yield pd.DataFrame(columns=["session_id", "as_of", "owner_user_id", "title", "is_active", "turns"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready, later = [], []
        for event in self.waiting.get():
            (ready if event[0] < passed else later).append(tuple(event))
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(e[0] for e in later) // 1000 + 1)
        else:
            self.waiting.clear()
        owner, title, started, turns = self.header.get() if self.header.exists() else (None, None, False, 0)
        # A turn comes before a delete of the same moment, which takes it along.
        ready.sort(key=lambda e: e[:2])
        for _, is_delete, user, query in ready:
            if is_delete:
                if started and (owner is None or user == owner):
                    turns = 0
                continue
            started, turns = True, turns + 1
            owner = user if owner is None else owner
            title = query[:TITLE_CHARS] if title is None and query else title
        self.header.update((owner, title, started, turns))
        out = []
        if ready and started:
            owned = ANON_PREFIX + key[0] if owner is None else owner
            out.append((key[0], pd.Timestamp(ready[-1][0], unit="us", tz="UTC"), owned, title or "", turns > 0, turns))
        yield pd.DataFrame(out, columns=["session_id", "as_of", "owner_user_id", "title", "is_active", "turns"])

    def close(self) -> None:
        pass


def session_stream(events: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """A row per session whenever the watermark has passed events of it: the header as of the last of them.

    `events`: a stream with session_id, at, is_delete, user_id, query. The newest row of a session is its header.
    """
    timed = events.filter("session_id is not null and at is not null").withWatermark("at", delay)
    columns = timed.select(
        F.col("session_id").cast("string").alias("session_id"),
        "at",
        F.unix_micros("at").alias("micros"),
        F.coalesce("is_delete", F.lit(False)).alias("is_delete"),
        F.col("user_id").cast("string").alias("user_id"),
        "query",
    )
    return columns.groupBy("session_id").transformWithStateInPandas(_Fold(), HEADERS, "Append", "EventTime")
