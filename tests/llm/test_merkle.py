import hashlib
from collections import defaultdict

import pytest

from subventa.llm import merkle as M


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, at):
    """Levels from `nodes` up: siblings left and right of the node on the way, and the top."""
    steps = []
    while len(nodes) > 1:
        first = at // 16 * 16
        run = nodes[first : first + 16]
        steps.append((run[: at - first], run[at - first + 1 :]))
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        at //= 16
    return steps, nodes[0]


def brute(rows, altered):
    """rows of (doc_id, tree, text); per row (leaf, subroot, root, proof digest, folded root, siblings)."""
    trees = defaultdict(list)
    for r in rows:
        trees[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for t in names:
        trees[t].sort(key=lambda x: x[:3])
    leaves = {t: [x[2] for x in trees[t]] for t in names}
    tops = [climb(leaves[t], 0)[1] for t in names]
    out = []
    for k, t in enumerate(names):
        above, root = climb(tops, k)
        for i, (_, _, own, r) in enumerate(trees[t]):
            steps = climb(leaves[t], i)[0] + above
            siblings = [b + a for b, a in steps]
            node = leaf((*r[:2], altered(r[2]))) if altered and r[2] is not None else own
            for b, a in steps:
                node = sha("".join([*b, node, *a]))
            out.append((r[0], own, tops[k], root, sha("".join(map("".join, siblings))), node, siblings))
    return sorted(out, key=str)


def run(spark, rows, altered=None):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, tree string, text string").selectExpr("*", "1 as idx", "2 as Digest", "3 as block")
    changed = None
    if altered:
        df = df.withColumn("now", F.upper("text"))
        changed = F.when(F.col("now").isNotNull(), M.leaf_digest(["doc_id", "tree", "now"]))
    got = M.sealed(M.leaves_of(df, ["doc_id", "tree", "text"], "tree", "doc_id", changed), proofs=True).collect()
    for r in got:
        assert r.verified == (r.folded_root == r.root)
    return sorted(((r.key, r.digest, r.subroot, r.root, r.proof_sha256, r.folded_root, r.proof) for r in got), key=str)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, "b": 17, None: 1, "": 2, "é": 256, "z": 257}, {str(i): 1 for i in range(40)}])
def test_equals_the_plain_tree(spark, sizes):
    rows = [(i * 7 % 10_007, t, f"text {i}") for t, n in sizes.items() for i in range(n)]
    got = run(spark, rows)
    assert got == brute(rows, None)
    assert all(r[5] == r[3] for r in got)


def test_several_rounds_and_changed_rows(spark, monkeypatch):
    """Superblocks of one level: a source of 5,000 rows needs four rounds, 300 sources three."""
    monkeypatch.setattr(M, "LEVELS", 1)
    monkeypatch.setattr(M, "SUPERBLOCK", 16)
    rows = [(i, "hot", "x" * (i % 3) if i % 11 else None) for i in range(5000)] + [(i, f"s{i}", "t") for i in range(300)]
    got = run(spark, rows, str.upper)
    assert got == brute(rows, str.upper)
    assert {r[5] == r[3] for r in got} == {True, False}


def test_superblocks_of_a_hot_source(spark):
    rows = [(i, "hot", "t") for i in range(9000)] + [(i, "cold", "t") for i in range(20)]
    got, wanted = run(spark, rows), brute(rows, None)
    assert got == wanted


def test_nulls_repeats_long_texts_and_empty_tables(spark):
    rows = [(1, "a", None), (1, "a", ""), (1, "a", "same"), (1, "a", "same"), (None, "a", "n"), (None, None, None), (2, None, "é" * 300_000)]
    assert run(spark, rows) == brute(rows, None)
    assert run(spark, []) == []
