"""Chat sessions folded from turn and delete events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subventa.operators.order import blocked_rank

# Title width and owner mark of signed-out sessions (fixed values).
TITLE_CHARS = 80
ANON_PREFIX = "anon-"

# Time span whose turns of one session share a window task.
BLOCK_SPAN = 86_400


@dataclass(frozen=True)
class Sessions:
    """`headers`: one row per session. `history`: its live turns with a position."""

    headers: DataFrame
    history: DataFrame


def owners(turns: DataFrame) -> DataFrame:
    """First signed-in user per session with the moment of the hand-over."""
    signed = F.when(F.col("user_id").isNotNull(), F.struct("at", "user_id"))
    return turns.groupBy("session_id").agg(F.min("at").alias("created_at"), F.min(signed).alias("_o")).select(
        "session_id", "created_at", F.col("_o.at").alias("owned_from"), F.col("_o.user_id").alias("owner")
    )


def owner_id(session_id: Column, owner: Column) -> Column:
    return F.coalesce(owner, F.concat(F.lit(ANON_PREFIX), session_id.cast("string")))


def allowed_deletes(deletes: DataFrame, owned: DataFrame) -> DataFrame:
    """Deletes of an existing session by someone who may delete it at that moment."""
    joined = deletes.join(owned, "session_id", "left")
    signed_out = F.col("owned_from").isNull() | (F.col("at") < F.col("owned_from"))
    return joined.filter(
        (F.col("at") >= F.col("created_at"))
        & (signed_out | F.coalesce(F.col("user_id") == F.col("owner"), F.lit(False)))
    ).select("session_id", "at")


def fold_sessions(turns: DataFrame, deletes: DataFrame, block: Column | None = None) -> Sessions:
    """Owners, titles, activity and live history.

    `turns`: session_id, at (unique per session), user_id, query and more;
    `deletes`: session_id, at, user_id. `block` cuts long sessions along `at`.
    """
    owned = owners(turns)
    last_delete = allowed_deletes(deletes, owned).groupBy("session_id").agg(F.max("at").alias("deleted_at"))
    live = turns.join(last_delete, "session_id", "left").filter(
        F.col("deleted_at").isNull() | (F.col("at") > F.col("deleted_at"))
    )
    titled = F.min(F.when(F.coalesce("query", F.lit("")) != "", F.struct("at", F.left("query", F.lit(TITLE_CHARS)).alias("t"))))
    titles = turns.groupBy("session_id").agg(titled.alias("_t"))
    kept = live.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"))
    headers = (
        owned.join(titles, "session_id")
        .join(kept, "session_id", "left")
        .select(
            "session_id",
            owner_id(F.col("session_id"), F.col("owner")).alias("owner_user_id"),
            F.coalesce("_t.t", F.lit("")).alias("title"),
            F.col("turns").isNotNull().alias("is_active"),
            F.coalesce("turns", F.lit(0)).alias("turns"),
        )
    )
    cut = F.floor(F.col("at").cast("double") / BLOCK_SPAN) if block is None else block
    history = blocked_rank(live.drop("deleted_at"), ["session_id"], [F.col("at")], cut, "position")
    return Sessions(headers, history)


def readable(headers: DataFrame, readers: DataFrame) -> DataFrame:
    """(session_id, reader_id, visible): signed-in sessions only to their owner.

    `readers`: session_id, reader_id (null when signed out).
    """
    anonymous = F.col("owner_user_id").startswith(ANON_PREFIX)
    may = F.col("is_active") & (anonymous | F.coalesce(F.col("owner_user_id") == F.col("reader_id"), F.lit(False)))
    joined = readers.join(headers.select("session_id", "owner_user_id", "is_active"), "session_id", "left")
    return joined.select("session_id", "reader_id", F.coalesce(may, F.lit(False)).alias("visible"))


def replay(history: DataFrame, visible: DataFrame) -> DataFrame:
    """History rows each permitted reader gets."""
    granted = visible.filter("visible").select("session_id", "reader_id", F.lit(True).alias("_granted"))
    return history.join(granted, "session_id").filter("_granted").drop("_granted")
