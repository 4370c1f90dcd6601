import numpy as np
from pyspark.sql import functions as F

from subventa.operators.dense import dense_top_k
from subventa.operators.vector_index import build_index, can_hold_better, compared_share, index_top_k, open_index
from tests.test_retrieval import corpus_frame, ranked, vectors

SF = "/root/testdata/sf0.1"


def asked(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "qid int, embedding array<double>")


def recall(got, want, k=10):
    return np.mean([len(set(got.get(q, [])) & set(ids)) / k for q, ids in want.items()])


def clusters(n, size, dim=64):
    m = np.repeat(vectors(n, dim, seed=9), size, axis=0) + 0.05 * np.random.default_rng(4).normal(size=(n * size, dim))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_given_vectors(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    corpus = e.select(F.col("vec_id").alias("grant_id"), "embedding", F.lit(None).cast("timestamp").alias("deleted_at"))
    queries = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    index = build_index(corpus, str(tmp_path / "i"), lists=32)
    assert index.sizes.sum() == corpus.count() and index.rows.count() == corpus.count()
    want = ranked(dense_top_k(queries, corpus, 10))
    share = compared_share(queries, index, 20)
    found = recall(ranked(index_top_k(queries, index, 10, probes=20)), want)
    print(f"recall {found:.3f} at a compared share of {share:.3f}")
    assert found >= 0.9 and share < 0.75
    assert ranked(index_top_k(queries, index, 10, probes=2, exact=True)) == want


def test_clusters_need_few_rows(spark, tmp_path):
    m = clusters(60, 30)
    index = build_index(corpus_frame(spark, m), str(tmp_path / "i"), lists=60)
    queries = asked(spark, m[::40])
    want = ranked(dense_top_k(queries, corpus_frame(spark, m), 10))
    assert compared_share(queries, index, 3) <= 0.1
    assert recall(ranked(index_top_k(queries, index, 10, probes=3)), want) >= 0.95
    assert ranked(index_top_k(queries, index, 10, probes=1, exact=True)) == want
    unit = m[::40]
    assert can_hold_better(index, unit, np.full(len(unit), 0.8)).mean() < 0.2  # the bound excludes most lists


def test_exact_with_filters_ties_blocks_and_odd_rows(spark, tmp_path):
    m = vectors(300, 8)
    m[50] = m[10]
    corpus = corpus_frame(spark, m, dead={3})
    odd = spark.createDataFrame([(1000, [0.0] * 8, "p1", "DE", "t", "s"), (1001, None, "p1", "DE", "t", "s")], "grant_id long, embedding array<double>, portal string, country string, title string, summary string")
    index = build_index(corpus.unionByName(odd.withColumn("deleted_at", F.lit(None).cast("timestamp"))), str(tmp_path / "i"), lists=12)
    rows = [(i, [float(x) for x in m[i]], "p1" if i % 2 else None, None if i % 3 else "de") for i in range(0, 60, 5)]
    queries = spark.createDataFrame(rows, "qid int, embedding array<double>, portal string, country string")
    want = ranked(dense_top_k(queries, corpus, 7))
    assert ranked(index_top_k(queries, index, 7, probes=2, exact=True)) == want
    assert ranked(index_top_k(queries, open_index(spark, str(tmp_path / "i")), 7, probes=2, exact=True, max_block_queries=4)) == want


def test_large_lists_are_split_and_equal_vectors_stay(spark, tmp_path):
    m = np.concatenate([clusters(6, 100, 16), np.repeat(vectors(1, 16, seed=2), 400, axis=0)])
    index = build_index(corpus_frame(spark, m), str(tmp_path / "i"), lists=5)
    assert index.sizes.sum() == len(m) and sorted(index.sizes)[-1] >= 400
    queries = asked(spark, m[::97])
    assert ranked(index_top_k(queries, index, 5, probes=1, exact=True)) == ranked(dense_top_k(queries, corpus_frame(spark, m), 5))


def test_empty(spark, tmp_path):
    m = vectors(20, 8)
    index = build_index(corpus_frame(spark, m).limit(0), str(tmp_path / "i"), lists=4)
    assert index_top_k(asked(spark, m), index, 5).count() == 0
    full = build_index(corpus_frame(spark, m), str(tmp_path / "j"), lists=4)
    assert index_top_k(asked(spark, m).limit(0), full, 5, exact=True).count() == 0


def test_blocks_of_queries_shuffle_no_corpus_row(spark):
    m = vectors(400, 8)
    queries = asked(spark, m[:40])
    corpus = corpus_frame(spark, m)
    assert ranked(dense_top_k(queries, corpus, 3, max_block_queries=6)) == ranked(dense_top_k(queries, corpus, 3))
    plan = dense_top_k(queries, corpus, 3)._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert shuffled and all("qid" in line for line in shuffled)  # tops of the tasks, no corpus row
