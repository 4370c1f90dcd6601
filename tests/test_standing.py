import numpy as np
from pyspark.sql import functions as F

from subventa.operators.alerts import near_pairs, new_alerts, sent_alerts
from subventa.operators.chains import on_circles, shortest_chains
from tests.test_retrieval import corpus_frame, vectors


def profiles_of(spark, m):
    return spark.createDataFrame([(f"s{i}", [float(x) for x in v]) for i, v in enumerate(m)], "profile_id string, embedding array<double>")


def wanted(p, m, threshold, dead=()):
    sims = np.round(p @ m.T, 9)
    return {(f"s{i}", j) for i, j in zip(*np.nonzero(sims >= threshold)) if j not in dead}


def test_alerts_are_told_once(spark, tmp_path):
    m, p = vectors(150, 6), vectors(25, 6, seed=8)
    corpus, profiles, sent = corpus_frame(spark, m, dead={7}), profiles_of(spark, p), sent_alerts(spark, str(tmp_path), 4)
    first = {(r.profile_id, r.grant_id) for r in new_alerts(profiles, corpus.filter("grant_id < 60"), sent, 0.5).collect()}
    assert first == {x for x in wanted(p, m, 0.5, {7}) if x[1] < 60} and first
    assert new_alerts(profiles, corpus.filter("grant_id < 60"), sent, 0.5).count() == 0
    second = {(r.profile_id, r.grant_id) for r in new_alerts(profiles, corpus, sent, 0.5).collect()}
    assert first | second == wanted(p, m, 0.5, {7}) and not first & second
    assert sent.read().count() == len(first | second)
    other = new_alerts(profiles, corpus.filter("grant_id < 60"), sent, 0.5, channel="push")
    assert other.count() == len(first)


def test_blocks_of_profiles_and_odd_rows(spark):
    m, p = vectors(80, 6), vectors(30, 6, seed=8)
    corpus = corpus_frame(spark, m).unionByName(corpus_frame(spark, m[:1]).withColumn("grant_id", F.lit(900).cast("long")).withColumn("embedding", F.array(*[F.lit(0.0)] * 6)))
    got = {(r.profile_id, r.grant_id) for r in near_pairs(profiles_of(spark, p), corpus, 0.4, block=7).collect()}
    assert got == wanted(p, m, 0.4)
    assert near_pairs(profiles_of(spark, p).limit(0), corpus, 0.4).count() == 0
    assert near_pairs(profiles_of(spark, p), corpus.limit(0), 0.4).count() == 0


def brute_chains(edges):
    after = {}
    for a, b in edges:
        if a is not None and b is not None:
            after.setdefault(a, set()).add(b)
    out = {}
    for start in after:
        level, steps = {start}, 0
        while level:
            steps += 1
            level = {b for a in level for b in after.get(a, ()) if (start, b) not in out}
            out.update({(start, b): steps for b in level})
    return out


def test_chains_on_trees_diamonds_and_circles(spark):
    tree = [(i, i // 2) for i in range(2, 40)]
    diamond = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("a", "e")]
    circle = [("x", "y"), ("y", "z"), ("z", "x"), ("z", "z"), ("p", "x"), (None, "x"), ("y", None), ("x", "y")]
    edges = [(str(a), str(b)) for a, b in tree] + diamond + circle
    df = spark.createDataFrame(edges, "start string, end string")
    chains = shortest_chains(df)
    assert {(r.start, r.end): r.steps for r in chains.collect()} == brute_chains(edges)
    assert chains.count() == len(brute_chains(edges))
    assert {(r.programme, r.steps) for r in on_circles(chains).collect()} == {("x", 3), ("y", 3), ("z", 1)}
    assert shortest_chains(df.limit(0)).count() == 0
