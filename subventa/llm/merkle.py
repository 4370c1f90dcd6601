"""Merkle manifest of a dataset with an inclusion proof for every row.

A row's leaf is the digest of its fields. Per tree (a source), leaves stand in key
order; every `FAN` consecutive nodes become their digest until one is left, the
subroot. Subroots in tree order give the root in the same way.

1. Leaves are numbered within their tree over sorted ranges, so a tree that holds a
   third of all rows spans many tasks.
2. A superblock is `LEVELS` levels of a tree (4,096 leaves). Superblocks are reduced one
   by one; their digests are the leaves of the next round, until every tree is one node.
   The rounds shrink by 4,096, so there are two or three.
3. Downwards, each superblock gets its outer nodes: all members of the runs on its way
   to the root, handed from round to round, so no run is read by all leaves beneath it.
4. Leaves and outer nodes are cogrouped by superblock in applyInPandas, where the local
   levels are reduced, every leaf's proof is joined, and the leaf (or a changed leaf) is
   folded along its siblings up to the root.

Each group holds at most 4,096 leaves and 16 outer nodes a level; nothing else is held
in memory, and no digest passes through the driver.

Defined cases: a null field is `-`, other fields are their UTF-8 byte count, `:` and the
value, so empty and null differ and long texts count whole. A null tree is a tree of its
own, before all others. Rows with equal or null keys are ordered (null first) by their
leaf; repeated rows are leaves of their own. A tree of one leaf has that leaf as subroot;
a row without siblings has the digest of nothing as proof. An empty table gives no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subventa.llm.ranking import numbered
from subventa.llm.store import materialise

FAN = 16
LEVELS = 3
SUPERBLOCK = FAN**LEVELS

_NODE = "tree string, idx long, n long, digest string, child_tree string, child_block long"
_OUTER = "tree string, block long, level int, place int, digest string, own boolean, top boolean"


def field(name: str) -> Column:
    value = F.col(name).cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(columns: list[str]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _height(n: int) -> int:
    levels = 0
    while n > 1:
        n = -(-n // FAN)
        levels += 1
    return levels


def _reduced(digests: list[str], n: int) -> list[list[str]]:
    """The levels of a superblock, from its nodes up; `n` nodes are in the whole tree."""
    levels = [digests]
    for _ in range(min(LEVELS, _height(n))):
        last = levels[-1]
        levels.append([_sha("".join(last[i : i + FAN])) for i in range(0, len(last), FAN)])
    return levels


def _block_root(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("idx")
    tree, first, n = rows["tree"].iat[0], int(rows["idx"].iat[0]), int(rows["n"].iat[0])
    block = first // SUPERBLOCK
    top = _reduced(rows["digest"].tolist(), n)[-1]
    return pd.DataFrame({"tree": [tree], "idx": [block], "n": [-(-n // SUPERBLOCK)], "digest": top, "child_tree": [tree], "child_block": [block]})


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """`nodes` and the superblock roots above them, until every tree is one node."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        last = rounds[-1].select("tree", "idx", "n", "digest")
        roots = last.filter("n > 1").groupBy("tree", F.floor(F.col("idx") / SUPERBLOCK).alias("block")).applyInPandas(_block_root, _NODE)
        single = last.filter("n = 1").select("*", F.col("tree").alias("child_tree"), F.lit(0).cast("long").alias("child_block"))
        rounds.append(materialise(roots.union(single), "roots"))
    return rounds


def _paths(top: bool):
    """Outer nodes of every node of a superblock: its own runs, then those of the superblock."""

    def run(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("idx")
        levels = _reduced(nodes["digest"].tolist(), int(nodes["n"].iat[0]) if len(nodes) else 1)
        above = list(outer.sort_values(["level", "place"])[["level", "place", "digest", "own", "top"]].itertuples(index=False, name=None))
        out = []
        for i, (tree, block) in enumerate(zip(nodes["child_tree"], nodes["child_block"])):
            for level in range(len(levels) - 1):
                at, place = i // FAN**level // FAN * FAN, i // FAN**level % FAN
                out += [(tree, block, level, k, d, k == place, top) for k, d in enumerate(levels[level][at : at + FAN])]
            out += [(tree, block, level + len(levels) - 1, *rest) for level, *rest in above]
        return pd.DataFrame(out, columns=["tree", "block", "level", "place", "digest", "own", "top"])

    return run


def _outer_nodes(rounds: list[DataFrame], outer: DataFrame, top: bool) -> DataFrame:
    """Outer nodes, handed down from the last round to the nodes of the first of `rounds`."""
    for nodes in reversed(rounds):
        blocks = nodes.withColumn("block", F.floor(F.col("idx") / SUPERBLOCK))
        outer = blocks.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(_paths(top), _OUTER)
        outer = materialise(outer, "outer")
    return outer


def _sealed_block(keep_proofs: bool):
    def run(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.sort_values("idx")
        digests = leaves["digest"].tolist()
        levels = _reduced(digests, int(leaves["n"].iat[0]) if len(leaves) else 1)
        sides, inside = [], 0
        for _, members in outer.sort_values(["level", "place"]).groupby("level"):
            own = members["own"].tolist().index(True)
            nodes = members["digest"].tolist()
            sides.append(("".join(nodes[:own]), "".join(nodes[own + 1 :]), nodes[:own] + nodes[own + 1 :]))
            inside += not members["top"].iat[0]

        def folded(node: str, steps: list) -> str:
            for before, after in steps:
                node = _sha(before + node + after)
            return node

        above = [s[:2] for s in sides]
        subroot = folded(levels[-1][0], above[:inside])
        root = folded(subroot, above[inside:])
        outer_text = "".join(b + a for b, a in above).encode()
        out: dict[str, list] = {"subroot": subroot, "root": root, "proof_sha256": [], "folded_root": [], "proof": []}
        for i, changed in enumerate(leaves["changed"]):
            steps = []
            for level in range(len(levels) - 1):
                node = i // FAN**level
                at = node // FAN * FAN
                steps.append(("".join(levels[level][at:node]), "".join(levels[level][node + 1 : at + FAN])))
            proof = hashlib.sha256("".join(b + a for b, a in steps).encode())
            proof.update(outer_text)
            out["proof_sha256"].append(proof.hexdigest())
            out["folded_root"].append(folded(changed or digests[i], steps + above))
            if keep_proofs:
                local = [[(b + a)[k : k + 64] for k in range(0, len(b + a), 64)] for b, a in steps]
                out["proof"].append(local + [s[2] for s in sides])
        if not keep_proofs:
            del out["proof"]
        return leaves[["key", "digest"]].assign(**out)

    return run


def leaves_of(docs: DataFrame, columns: list[str], tree: str, key: str, changed: Column | None = None) -> DataFrame:
    """key, tree (null as an empty string, others behind `=`), digest, and the digest a row has now where `changed` gives one."""
    return docs.select(
        F.col(key).cast("long").alias("key"),
        F.coalesce(F.concat(F.lit("="), F.col(tree)), F.lit("")).alias("tree"),
        leaf_digest(columns).alias("digest"),
        (F.lit(None).cast("string") if changed is None else changed).alias("changed"),
    )


def sealed(leaves: DataFrame, proofs: bool = False) -> DataFrame:
    """One row per leaf: key, digest, subroot, root, proof_sha256, folded_root, verified.

    `folded_root` comes from `changed` (or the leaf itself) and the siblings the manifest
    holds; `verified` tells whether it equals the root. With `proofs`, column proof lists
    the sibling digests of every level from the leaf up. Cost: leaves are sorted once and
    dealt twice, 150 bytes a row; texts are read once, for the digests.
    """
    written = materialise(leaves, "leaves")
    nodes = materialise(numbered(written, ["tree"], [F.col("key").asc_nulls_first(), F.col("digest")], "placed"), "numbered")
    inside = _rounds(nodes)
    tops = inside[-1].select(F.lit("").alias("all"), F.col("tree").alias("child_tree"), "digest")
    tops = numbered(tops, ["all"], [F.col("child_tree")], "subroots").withColumnRenamed("all", "tree")
    among = _rounds(materialise(tops.withColumn("child_block", F.lit(0).cast("long")), "subroots"))

    outer = nodes.sparkSession.createDataFrame([], _OUTER)
    outer = _outer_nodes(among[:-1], outer, top=True) if len(among) > 1 else outer
    outer = _outer_nodes(inside[1:-1], outer, top=False)
    schema = "key string, digest string, subroot string, root string, proof_sha256 string, folded_root string"
    blocks = nodes.select(
        "tree", F.floor(F.col("idx") / SUPERBLOCK).alias("block"), "idx", "n", F.col("key").cast("string").alias("key"), "digest", "changed"
    )
    done = (
        blocks.groupBy("tree", "block")
        .cogroup(outer.groupBy("tree", "block"))
        .applyInPandas(_sealed_block(proofs), schema + (", proof array<array<string>>" if proofs else ""))
    )
    return done.withColumns({"key": F.col("key").cast("long"), "verified": F.col("folded_root") == F.col("root")})
