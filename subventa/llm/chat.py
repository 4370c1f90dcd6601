"""Reply trees as chat texts.

Nodes (tree_id, node_id, parent_id, role, text, score) become one text per
chosen branch. All steps over the tree are self-joins by pointer doubling: a
round looks twice as far up as the one before, so a branch of n turns needs
log2(n) rounds and no row grows with the depth.

1. `jumps` writes, per round, every node's ancestor 2**round turns up, and sums
   depth and score up to the root.
2. A leaf is a branch; branches of a tree are ranked by mean score, ties by the
   smaller leaf.
3. `paths` walks the stored jumps down from the largest and enumerates the nodes
   of the chosen branches.
4. A branch's turns are formatted into one text.

The template is `### <role>: <text></turn>` per turn. Backslash, `###`, `</turn>`
and, in roles, the colon are escaped by a backslash, so the text can be cut at
unescaped marks and read back exactly. `read_back` gives turns and loss mask.

Defined cases: null text and null role are empty; a null score counts as 0. A
node whose parent is missing or null is a root; nodes on a circle have no root
and make no branch. Of rows that repeat a (tree_id, node_id) one stays, the
smallest by parent, role and text. Null tree or node ids are no nodes. Extra
columns are not carried.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subventa.llm.store import materialise

START, MIDDLE, END = "### ", ": ", "</turn>"
_KEY = ["tree_id", "node_id"]


def escaped(text: Column, role: bool = False) -> Column:
    """Backslashes doubled, marks behind a backslash."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    out = F.regexp_replace(out, "(###|</turn>|:)" if role else "(###|</turn>)", r"\\$1")
    return out


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escaped(role, True), F.lit(MIDDLE), escaped(text), F.lit(END))


_TURN = re.compile(r"### ((?:[^\\:]|\\.)*?): ((?:[^\\]|\\.)*?)</turn>", re.S)
_ESCAPE = re.compile(r"\\(\\|###|</turn>|:)")


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def read_back(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) per turn; start and end bound the escaped text in `formatted`."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


def _nodes(tree: DataFrame) -> DataFrame:
    rows = tree.select(
        F.col("tree_id").cast("long"), F.col("node_id").cast("long"), F.col("parent_id").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    ).filter("tree_id is not null and node_id is not null")
    first = F.min(F.struct("parent_id", "role", "text", "score")).alias("row")
    return rows.groupBy(*_KEY).agg(first).select(*_KEY, "row.*")


def jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Stored tables (tree_id, node_id, up) of each round, and per rooted node its depth and score sum."""
    ids = nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("known"))
    step = nodes.join(ids, ["tree_id", "parent_id"], "left").select(
        *_KEY, F.when(F.col("known"), F.col("parent_id")).alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")
    )
    step = materialise(step, "jump")
    state = ["tree_id", "node_id", "up", "depth", "total"]
    active, done = step.filter("up is not null").select(state), step.filter("up is null").select(state)
    rounds = [active.select(*_KEY, "up")]
    most = step.count()
    reach = 1
    # Nodes that have met their root wait in `done`; only the others are joined again.
    while rounds[-1].take(1) and reach <= most:
        above = done.union(active).select("tree_id", F.col("node_id").alias("up"), F.col("up").alias("far"), F.col("depth").alias("d"), F.col("total").alias("t"))
        moved = active.join(above, ["tree_id", "up"], "left").select(
            *_KEY, F.col("far").alias("up"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), (F.col("total") + F.coalesce("t", F.lit(0.0))).alias("total")
        )
        moved = materialise(moved, "jump")
        active, done = moved.filter("up is not null").select(state), done.union(moved.filter("up is null").select(state))
        rounds.append(active.select(*_KEY, "up"))
        reach *= 2
    return rounds, done.select(*_KEY, "depth", "total")


def ranked_branches(nodes: DataFrame, summed: DataFrame) -> DataFrame:
    """(tree_id, leaf, depth, score, rank from 0) of every branch."""
    inner = nodes.select("tree_id", F.col("parent_id").alias("node_id")).filter("node_id is not null").distinct()
    leaves = summed.join(inner, _KEY, "left_anti").select("tree_id", F.col("node_id").alias("leaf"), "depth", (F.col("total") / F.col("depth")).alias("score"))
    order = Window.partitionBy("tree_id").orderBy(F.col("score").desc(), "leaf")
    return leaves.withColumn("rank", F.row_number().over(order) - 1)


def paths(branches: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """(tree_id, leaf, node_id) for all nodes of the branches."""
    found = branches.select("tree_id", "leaf", F.col("leaf").alias("node_id"))
    for table in reversed(rounds):
        above = found.join(table, _KEY).select("tree_id", "leaf", F.col("up").alias("node_id"))
        # Written per round, or the plan would double with every round.
        found = materialise(found.union(above), "path")
    return found


def conversations_of(tree: DataFrame, top: int | None = None) -> DataFrame:
    """One row per chosen branch: tree_id, leaf, rank, score, n_turns, formatted.

    `top` keeps the best branches of each tree; None keeps all.
    """
    nodes = materialise(_nodes(tree), "nodes")
    rounds, summed = jumps(nodes)
    branches = ranked_branches(nodes, summed)
    if top is not None:
        branches = branches.filter(F.col("rank") < top)
    branches = materialise(branches, "branches")
    turns = (
        paths(branches, rounds)
        .join(nodes.select(*_KEY, turn_text(F.col("role"), F.col("text")).alias("turn")), _KEY)
        .join(summed.select(*_KEY, F.col("depth").alias("place")), _KEY)
    )
    lists = turns.groupBy("tree_id", "leaf").agg(F.sort_array(F.collect_list(F.struct("place", "turn"))).alias("turns"))
    joined = F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("formatted")
    return lists.select("tree_id", "leaf", F.size("turns").cast("long").alias("n_turns"), joined).join(
        branches.select("tree_id", "leaf", "rank", "score"), ["tree_id", "leaf"]
    )
