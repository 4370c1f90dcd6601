"""Sessions over conversations; rates, searches, saved items over events; deadline buckets over orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from subventa.functions.labels import days_left, deadline_bucket
from subventa.operators import activity as A
from subventa.operators import sessions as S
from subventa.plans.registry import query, table
from subventa.sources.shared import shared_path
from subventa.streaming.folds import RATES, request_rate_stream, with_state_store

# User turns are session turns, signed in from the third turn on unless the
# conversation is short; answers stand for delete requests, by the owner
# where they hold a comma and by a stranger where they hold none.
_SESSION_SQL = """
turns AS (SELECT conv_id AS session_id, turn AS "at", CASE WHEN turn >= 2 THEN 'u' || conv_id END AS user_id, text AS query FROM conversations WHERE role <> 'assistant'),
dels AS (SELECT conv_id AS session_id, turn AS "at", CASE WHEN contains(text, ',') THEN 'u' || conv_id ELSE 'stranger' END AS user_id FROM conversations
  WHERE role = 'assistant'),
own AS (SELECT session_id, min("at") AS created_at, min("at") FILTER (user_id IS NOT NULL) AS owned_from, arg_min(user_id, "at") FILTER (user_id IS NOT NULL) AS owner
  FROM turns GROUP BY session_id),
ok AS (SELECT d.session_id, max(d."at") AS deleted_at FROM dels d JOIN own o USING (session_id)
  WHERE d."at" >= o.created_at AND (o.owned_from IS NULL OR d."at" < o.owned_from OR d.user_id = o.owner) GROUP BY d.session_id),
live AS (SELECT t.*, row_number() OVER (PARTITION BY t.session_id ORDER BY t."at") - 1 AS position FROM turns t LEFT JOIN ok USING (session_id)
  WHERE ok.deleted_at IS NULL OR t."at" > ok.deleted_at),
head AS (SELECT o.session_id, coalesce(o.owner, 'anon-' || o.session_id) AS owner_user_id,
  left((SELECT arg_min(query, "at") FROM turns t WHERE t.session_id = o.session_id AND query <> ''), 80) AS title,
  (SELECT count(*) FROM live l WHERE l.session_id = o.session_id) AS turns FROM own o)
"""


def _sessions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    key = F.concat(F.lit("u"), F.col("conv_id").cast("string"))
    turns = c.filter(F.col("role") != "assistant").select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("at"),
        F.when(F.col("turn") >= 2, key).alias("user_id"),
        F.col("text").alias("query"),
    )
    deletes = c.filter(F.col("role") == "assistant").select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("at"),
        F.when(F.col("text").contains(","), key).otherwise("stranger").alias("user_id"),
    )
    return S.fold_sessions(turns, deletes, block=F.floor(F.col("at") / 4))


@query("session_headers", f"WITH {_SESSION_SQL} SELECT session_id, owner_user_id, title, turns > 0 AS is_active, turns FROM head")
def session_headers(spark, sf_dir):
    return _sessions(spark, sf_dir).headers


@query("session_history", f"WITH {_SESSION_SQL} SELECT session_id, \"at\", user_id, query, position FROM live")
def session_history(spark, sf_dir):
    return _sessions(spark, sf_dir).history


@query("session_owners", f"WITH {_SESSION_SQL} SELECT session_id, owner_user_id FROM head")
def session_owners(spark, sf_dir):
    return _sessions(spark, sf_dir).headers.select("session_id", "owner_user_id")


@query(
    "session_replay",
    f"""WITH {_SESSION_SQL}, readers AS (SELECT session_id, r AS reader_id FROM own, (VALUES (NULL), ('other'), ('self')) v(r)),
    named AS (SELECT session_id, CASE WHEN reader_id = 'self' THEN 'u' || session_id ELSE reader_id END AS reader_id FROM readers)
    SELECT n.session_id, n.reader_id, l."at", l.position FROM named n JOIN head h USING (session_id) JOIN live l USING (session_id)
    WHERE h.turns > 0 AND (h.owner_user_id LIKE 'anon-%' OR coalesce(h.owner_user_id = n.reader_id, FALSE))""",
)
def session_replay(spark, sf_dir):
    folded = _sessions(spark, sf_dir)
    own = F.concat(F.lit("u"), F.col("session_id").cast("string"))
    readers = folded.headers.select(
        "session_id", F.explode(F.array(F.lit(None).cast("string"), F.lit("other"), own)).alias("reader_id")
    )
    shown = S.replay(folded.history, S.readable(folded.headers, readers))
    return shown.select("session_id", "reader_id", "at", "position")


# --- events ------------------------------------------------------------------------


@query(
    "request_rates",
    """WITH h AS (SELECT event_id, event_type AS identity, CAST(floor(epoch(ts)) AS BIGINT) AS sec, ts FROM events WHERE event_type <> 'view'),
    w AS (SELECT *, count(*) OVER (PARTITION BY identity ORDER BY sec RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW)
      - count(*) OVER (PARTITION BY identity, sec) + row_number() OVER (PARTITION BY identity, sec ORDER BY ts, event_id) AS in_window FROM h)
    SELECT event_id, identity, in_window, in_window > 80 AS limited FROM w""",
)
def request_rates(spark, sf_dir):
    """One identity per event type and a window of a day, so that limits are met."""
    hits = table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.col("event_type").alias("identity"),
        F.when(F.col("event_type") == "view", "/health").otherwise("/grants").alias("path"),
    )
    rated = A.request_rates(hits, ["ts", "event_id"], window_seconds=86_400, block_seconds=172_800)
    return rated.select("event_id", "identity", "in_window", "limited")


@query(
    "request_rates_minute",
    """WITH h AS (SELECT event_id, 'all' AS identity, CAST(floor(epoch(ts)) AS BIGINT) AS sec, ts FROM events WHERE event_type <> 'view'),
    w AS (SELECT *, count(*) OVER (PARTITION BY identity ORDER BY sec RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)
      - count(*) OVER (PARTITION BY identity, sec) + row_number() OVER (PARTITION BY identity, sec ORDER BY ts, event_id) AS in_window FROM h)
    SELECT event_id, in_window, in_window > 80 AS limited FROM w""",
)
def request_rates_minute(spark, sf_dir):
    """One identity sends everything, in the standard window."""
    hits = table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.lit("all").alias("identity"),
        F.when(F.col("event_type") == "view", "/health").otherwise("/grants").alias("path"),
    )
    return A.request_rates(hits, ["ts", "event_id"]).select("event_id", "in_window", "limited")


@query(
    "request_rates_stream",
    """WITH h AS (SELECT event_type AS identity, CAST(floor(epoch(ts)) AS BIGINT) AS sec, ts FROM events WHERE event_type <> 'view'),
    s AS (SELECT identity, sec, count(*) AS hits FROM h GROUP BY identity, sec),
    w AS (SELECT *, sum(hits) OVER (PARTITION BY identity ORDER BY sec RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS in_window FROM s)
    SELECT identity, sec, hits, CAST(in_window AS BIGINT) AS in_window, CAST(least(hits, greatest(0, in_window - 3)) AS BIGINT) AS limited FROM w
    WHERE (sec + 1) * 1000 <= (SELECT epoch_ms(max(ts)) FROM h) - 10000""",
)
def request_rates_stream(spark, sf_dir):
    """The events as a stream, drained once: seconds that the watermark has passed, windows of an hour and 3 hits."""
    # As a pattern, since a stream takes a table of one file under no other name.
    given = f"{sf_dir}/events.parque[t]"
    events = with_state_store(spark).readStream.schema(table(spark, sf_dir, "events").schema).parquet(given)
    hits = events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("identity"),
        F.when(F.col("event_type") == "view", "/health").otherwise("/grants").alias("path"),
    )
    out = shared_path(spark, "rates")
    rates = request_rate_stream(hits, delay="10 seconds", window_seconds=3600, limit=3)
    run = rates.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    run.awaitTermination()
    stored = spark.read.schema(RATES).parquet(out)
    return stored.select("identity", F.unix_seconds("second").alias("sec"), "hits", "in_window", "limited")


@query(
    "recent_searches",
    """WITH s AS (SELECT user_id, ts, event_id, trim(CASE WHEN event_type = 'click' THEN upper(event_type) || '  ' WHEN event_type = 'error' THEN '  ' ELSE ' ' || event_type END
        || CASE WHEN event_type = 'error' THEN '' ELSE CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR) END) AS query FROM events),
    d AS (SELECT *, row_number() OVER (PARTITION BY user_id, lower(query) ORDER BY ts DESC, event_id DESC) AS rn FROM s WHERE query <> ''),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS rank FROM d WHERE rn = 1)
    SELECT user_id, ts, event_id, query, CAST(rank AS INTEGER) AS rank FROM r WHERE rank < 8""",
)
def recent_searches(spark, sf_dir):
    kind = F.col("event_type")
    number = F.floor(F.col("value") / 20).cast("string")
    text = (
        F.when(kind == "click", F.concat(F.upper(kind), F.lit("  "), number))
        .when(kind == "error", "  ")
        .otherwise(F.concat(F.lit(" "), kind, number))
    )
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", text.alias("query"))
    return A.recent_searches(rows, ["ts", "event_id"])


@query(
    "saved_items",
    """WITH e AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) / 10 AS item, ts, event_id,
        CASE event_type WHEN 'purchase' THEN 'remove' WHEN 'signup' THEN CASE WHEN value > 60 THEN 'clear' END ELSE 'toggle' END AS action FROM events),
    x AS (SELECT user_id, CAST(floor(item) AS BIGINT) AS item_id, ts, event_id, action FROM e),
    c AS (SELECT user_id, max((ts, event_id)) AS cleared FROM x WHERE action = 'clear' GROUP BY user_id),
    r AS (SELECT user_id, item_id, max((ts, event_id)) AS removed FROM x WHERE action = 'remove' GROUP BY user_id, item_id),
    t AS (SELECT x.user_id, x.item_id, count(*) AS n, max(x.ts) AS ts, arg_max(x.event_id, (x.ts, x.event_id)) AS event_id FROM x LEFT JOIN c USING (user_id)
      LEFT JOIN r ON r.user_id = x.user_id AND r.item_id = x.item_id
      WHERE action = 'toggle' AND (cleared IS NULL OR (x.ts, x.event_id) > cleared) AND (removed IS NULL OR (x.ts, x.event_id) > removed) GROUP BY x.user_id, x.item_id)
    SELECT user_id, item_id, ts, event_id FROM t WHERE n % 2 = 1""",
)
def saved_items(spark, sf_dir):
    kind = F.col("event_type")
    action = (
        F.when(kind == "purchase", "remove")
        .when(kind == "signup", F.when(F.col("value") > 60, "clear"))
        .otherwise("toggle")
    )
    item = F.floor(F.get_json_object("props", "$.k").cast("bigint") / 10)
    return A.saved_items(table(spark, sf_dir, "events").withColumn("item_id", item), ["ts", "event_id"], action)


# --- deadlines ----------------------------------------------------------------------------

_AS_OF = "1998-06-15 07:30:00"


@query(
    "deadline_buckets",
    f"""WITH d AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS deadline FROM orders),
    x AS (SELECT *, CAST(floor((epoch_us(deadline) - epoch_us(TIMESTAMP '{_AS_OF}')) / 86400000000.0 + 0.5) AS BIGINT) AS days FROM d)
    SELECT o_orderkey, days, CASE WHEN deadline IS NULL THEN 'rolling' WHEN days < 0 THEN 'closed' WHEN days <= 30 THEN 'closing_soon' ELSE 'later' END AS bucket FROM x""",
)
def deadline_buckets(spark, sf_dir):
    deadline = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("timestamp"))
    as_of = F.lit(_AS_OF).cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", days_left(deadline, as_of).alias("days"), deadline_bucket(deadline, as_of).alias("bucket")
    )
