import numpy as np
import pytest
from pyspark.sql import functions as F

from subventa.operators import cache as K
from subventa.operators import retrieve as R
from subventa.operators.dense import approximate_top_k, dense_top_k, projection_keys, projection_lines
from subventa.operators.fusion import reciprocal_rank_fusion
from subventa.operators.sparse import sparse_top_k
from tests.test_functions import reference_grams


def vectors(n, dim=8, seed=1):
    m = np.random.default_rng(seed).normal(size=(n, dim))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def corpus_frame(spark, m, dead=()):
    rows = [
        (i, [float(x) for x in v], f"p{i % 3}", "DE" if i % 2 else "EU", f"Title {i} grant", f"Summary text number {i} for founders", i in dead)
        for i, v in enumerate(m)
    ]
    df = spark.createDataFrame(rows, "grant_id long, embedding array<double>, portal string, country string, title string, summary string, dead boolean")
    return df.withColumn("deleted_at", F.when(F.col("dead"), F.lit("2026-01-01").cast("timestamp"))).drop("dead").repartition(4)


def brute(q, m, k, allow=lambda i: True):
    sims = np.round(m @ q, 9)
    order = sorted((i for i in range(len(m)) if allow(i)), key=lambda i: (-sims[i], i))
    return order[:k]


def ranked(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append(r["grant_id"])
    return out


def test_dense_both_routes(spark):
    m = vectors(200)
    m[50] = m[10]  # exact ties are ordered by id
    corpus = corpus_frame(spark, m, dead={3})
    q = [(i, [float(x) for x in m[i]]) for i in (10, 20, 30, 50, 60)]
    queries = spark.createDataFrame(q, "qid int, embedding array<double>")
    want = {i: brute(m[i], m, 7, lambda j: j != 3) for i in (10, 20, 30, 50, 60)}
    assert ranked(dense_top_k(queries, corpus, 7)) == want
    assert ranked(dense_top_k(queries, corpus, 7, max_block_queries=2, cell_rows=30)) == want


def test_dense_filters(spark):
    m = vectors(120)
    queries = spark.createDataFrame(
        [(1, [float(x) for x in m[1]], "p1", None), (2, [float(x) for x in m[2]], None, "de"), (3, [float(x) for x in m[3]], "nope", None)],
        "qid int, embedding array<double>, portal string, country string",
    )
    got = ranked(dense_top_k(queries, corpus_frame(spark, m), 5))
    assert got == {1: brute(m[1], m, 5, lambda i: i % 3 == 1), 2: brute(m[2], m, 5, lambda i: i % 2 == 1)}


def compared_share(q, m, lines, tables, flips):
    directions = projection_lines(m.shape[1], lines, tables, 42)
    a, b = projection_keys(q, directions), projection_keys(m, directions)
    differ = np.bitwise_count(a[:, None, :] ^ b[None, :, :])
    return (differ <= flips).any(axis=2).mean()


def recall_of(spark, q, m, **settings):
    corpus = corpus_frame(spark, m)
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "qid int, embedding array<double>")
    got, want = ranked(approximate_top_k(queries, corpus, 10, **settings)), ranked(dense_top_k(queries, corpus, 10))
    return np.mean([len(set(got.get(i, [])) & set(want[i])) / 10 for i in range(len(q))])


def test_approximate_on_vectors_without_structure(spark):
    m = vectors(600, 64)
    assert compared_share(m[:60], m, 8, 4, 2) <= 0.5
    assert recall_of(spark, m[:60], m) >= 0.75


def test_approximate_on_clusters_compares_few(spark):
    rng = np.random.default_rng(4)
    m = np.repeat(vectors(60, 64, seed=9), 12, axis=0) + 0.05 * rng.normal(size=(720, 64))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    assert compared_share(m[:80], m, 10, 4, 1) <= 0.1
    assert recall_of(spark, m[:80], m, lines=10, flips=1) >= 0.95


def test_approximate_is_the_same_in_small_cells(spark):
    m = vectors(200, 16)
    corpus = corpus_frame(spark, m)
    queries = spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in range(40)], "qid int, embedding array<double>")
    assert ranked(approximate_top_k(queries, corpus, 10)) == ranked(approximate_top_k(queries, corpus, 10, cell_rows=3, cell_queries=4))


@pytest.mark.parametrize("lines, flips", [(8, 2), (8, 0)])
def test_approximate_equals_brute_force_over_met_rows(spark, lines, flips):
    """Whole blocks and by keys; a row whose id comes again takes one place, a zero vector none, filters hold."""
    m = np.repeat(vectors(300, 16), 2, axis=0)
    m[7] = 0
    ids = [i // 2 if i % 6 < 2 else i + 1000 for i in range(600)]
    rows = [(ids[i], [float(x) for x in v], f"p{i % 3}", None) for i, v in enumerate(m)]
    corpus = spark.createDataFrame(rows, "grant_id long, embedding array<double>, portal string, deleted_at timestamp")
    asked = [(i, [float(x) for x in m[i]], "p1" if i % 4 else None) for i in range(0, 240, 2)]
    queries = spark.createDataFrame(asked, "qid int, embedding array<double>, portal string")
    keys = projection_keys(m, projection_lines(16, lines, 4, 42))
    want = {}
    for q, _, portal in asked:
        near = (np.bitwise_count(keys ^ keys[q]) <= flips).any(axis=1) & m.any(axis=1)
        sims = {}
        for i in np.flatnonzero(near):
            if portal in (None, f"p{i % 3}"):
                sims[ids[i]] = max(sims.get(ids[i], -2), round(float(m[i] @ m[q]), 9))
        if sims:
            want[q] = sorted(sims, key=lambda i: (-sims[i], i))[:3]
    assert ranked(approximate_top_k(queries, corpus, 3, lines=lines, flips=flips)) == want
    assert ranked(approximate_top_k(queries, corpus, 3, lines=lines, flips=flips, cell_rows=50, cell_queries=20)) == want


def test_approximate_hands_on_k_rows_per_block(spark, monkeypatch):
    """Not k rows for each of the keys a query looks up."""
    from subventa.operators import dense

    handed = []
    final = dense.top_per_key

    def counted(df, *args):
        handed.append(df.selectExpr("count(*)").first()[0])
        return final(df, *args)

    monkeypatch.setattr(dense, "top_per_key", counted)
    m = vectors(200, 16)
    queries = spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in range(40)], "qid int, embedding array<double>")
    approximate_top_k(queries, corpus_frame(spark, m), 10).count()
    assert handed == [400]


def test_sparse_both_routes(spark):
    docs = [
        (1, "Gründerstipendium für Hochschulen", "Das Stipendium hilft Gründern."),
        (2, "Loan for small business", "A loan for small and medium business owners"),
        (3, "Business loans", "unrelated"),
        (4, "", "business loan small"),
    ]
    corpus = spark.createDataFrame(docs, "grant_id int, title string, summary string").withColumn("deleted_at", F.lit(None).cast("timestamp"))
    queries = spark.createDataFrame([(1, "small business loan"), (2, "gründerstipendium"), (3, "  ")], "qid int, query string")

    def sim(a, b):
        a, b = reference_grams(a), reference_grams(b)
        return len(a & b) / len(a | b) if a | b else 0.0

    want = {}
    for qid, text in ((1, "small business loan"), (2, "gründerstipendium")):
        scored = [(max(sim(t, text), sim(s, text)), i) for i, t, s in docs]
        want[qid] = [i for s, i in sorted((-s, i) for s, i in scored if s >= 0.3)]
    assert ranked(sparse_top_k(queries, corpus)) == want
    assert ranked(sparse_top_k(queries, corpus, max_broadcast_grams=1)) == want
    assert sparse_top_k(queries.filter("qid = 3"), corpus).count() == 0


def lists(spark, dense, sparse):
    def frame(ids):
        return spark.createDataFrame([(1, g, i) for i, g in enumerate(ids)], "qid int, grant_id string, rank int")

    return reciprocal_rank_fusion(frame(dense), frame(sparse)).orderBy("fused_rank").collect()


def test_fusion(spark):
    assert [r["grant_id"] for r in lists(spark, ["a", "b", "c"], [])] == ["a", "b", "c"]
    both = lists(spark, ["a", "c"], ["b", "c"])
    assert both[0]["grant_id"] == "c" and (both[0]["dense_rank"], both[0]["sparse_rank"]) == (1, 1)
    single = lists(spark, ["a"], [])[0]
    assert single["rrf_score"] == pytest.approx(1 / 61) and single["sparse_rank"] is None
    assert [r["grant_id"] for r in lists(spark, ["a", "a", "b"], [])] == ["a", "b"]


def test_modes(spark):
    m = vectors(80)
    corpus = corpus_frame(spark, m, dead={5})
    queries = spark.createDataFrame(
        [(1, "Title 7 grant", [float(x) for x in m[7]]), (2, "number 33 for founders", [float(x) for x in m[5]])],
        "qid int, query string, embedding array<double>",
    )
    dense = R.retrieve(queries, corpus, R.DENSE, 5).hits.collect()
    assert all(r["dense_rank"] == r["rank"] and r["rrf_score"] is None for r in dense) and 5 not in {r["grant_id"] for r in dense}
    hybrid = R.retrieve(queries, corpus, R.HYBRID, 5).hits
    assert hybrid.filter("rerank_score is not null").count() == 0 and hybrid.filter("rrf_score is null").count() == 0
    full = R.retrieve(queries, corpus, R.HYBRID_RERANK, 5, R.contains_scorer)
    best = full.hits.filter("qid = 1 and rank = 0").first()
    assert (best["grant_id"], best["final_score"]) == (7, 10.0)
    counts = {r["qid"]: r for r in R.stage_counts(full, queries).collect()}
    assert counts[1]["dense_count"] == 50 and counts[1]["rerank_count"] == min(50, counts[1]["fused_count"])
    with pytest.raises(ValueError):
        R.retrieve(queries, corpus, R.HYBRID_RERANK)


def test_stage_counts_search_once(spark):
    """The counts read the written legs: no search is left in their plan."""
    m = vectors(40)
    corpus = corpus_frame(spark, m)
    queries = spark.createDataFrame([(1, "Title 7 grant", [float(x) for x in m[7]])], "qid int, query string, embedding array<double>")
    for mode, stages in ((R.HYBRID_RERANK, 4), (R.HYBRID, 3), (R.DENSE, 1)):
        counts = R.stage_counts(R.retrieve(queries, corpus, mode, 5, R.contains_scorer), queries)
        plan = counts._jdf.queryExecution().toString()
        assert "MapInPandas" not in plan and "MapInArrow" not in plan
        assert sum(v > 0 for n, v in counts.first().asDict().items() if n != "qid") == stages


def test_expansion(spark):
    queries = spark.createDataFrame([(1, "q", [1.0, 0.0]), (2, "q", [1.0, 0.0])], "qid int, query string, embedding array<double>")
    hypo = spark.createDataFrame(
        [(1, i, v) for i, v in enumerate([[0.0, 1.0], [0.0, 1.0], [1.0, 0.0], [-9.0, 0.0]])], "qid int, pos int, embedding array<double>"
    )
    got = {r["qid"]: r for r in R.expand_queries(queries, hypo).collect()}
    assert got[1]["embedding"] == pytest.approx([1 / 5**0.5, 2 / 5**0.5]) and got[1]["used_hyde"]
    assert got[2]["embedding"] == [1.0, 0.0] and not got[2]["used_hyde"]


def test_cache(spark):
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    rows = [(f"q{i}", [float(i == j) for j in range(6)], f"2026-01-01 0{i + 1}:00:00", None) for i in range(5)]
    rows.append(("old", [0.0] * 5 + [1.0], "2025-12-31 23:00:00", None))
    entries = spark.createDataFrame(rows, "query string, embedding array<double>, t string, portal string")
    entries = entries.withColumn("cached_at", F.col("t").cast("timestamp")).drop("t")
    empty = entries.withColumn("key", F.lit("")).filter(F.lit(False))
    kept = K.store(empty, entries, now, max_entries=3)
    assert {r["query"] for r in kept.collect()} == {"q2", "q3", "q4"}
    again = K.store(kept, entries.filter("query = 'q4'").withColumn("query", F.lit("q4 again")).withColumn("cached_at", F.lit("2026-01-01 20:00:00").cast("timestamp")), now)
    assert {r["query"] for r in again.collect()} == {"q2", "q3", "q4 again"}
    ask = spark.createDataFrame(
        [(1, [float(4 == j) for j in range(6)], None), (2, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], None), (3, [float(4 == j) for j in range(6)], "kfw")],
        "qid int, embedding array<double>, portal string",
    )
    assert [(r["qid"], r["cached_for_query"]) for r in K.lookup(ask, kept, now).collect()] == [(1, "q4")]


def test_cached_retrieval_fetches_misses_alone(spark):
    from subventa.operators.retrieve import contains_scorer, retrieve

    m = vectors(40, 16, seed=3)
    corpus = corpus_frame(spark, m)
    schema = "qid int, query string, embedding array<double>, portal string"
    ask = spark.createDataFrame([(i, f"title {i} grant", [float(x) for x in m[i]], "p1" if i == 2 else None) for i in range(4)], schema)
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    hit = "array<struct<rank int, grant_id bigint, final_score double, dense_rank int, sparse_rank int, rrf_score double, rerank_score double>>"
    counts = ", ".join(f"{n} bigint" for n in ("dense_count", "sparse_count", "fused_count", "rerank_count"))
    empty = spark.createDataFrame([], f"key string, query string, embedding array<double>, portal string, cached_at timestamp, hits {hit}, {counts}")
    rows = lambda df: sorted((r.qid, r["rank"], r.grant_id, r.final_score) for r in df.collect())

    plain = retrieve(ask, corpus, score_fn=contains_scorer)
    first = K.retrieve_cached(ask.filter("qid < 3"), corpus, empty, now, contains_scorer)
    assert rows(first.hits) == rows(plain.hits.filter("qid < 3")) and not first.hits.filter("cache_hit").count()
    cache = spark.createDataFrame(first.cache.collect(), first.cache.schema)
    assert cache.count() == 3

    # Another corpus shows what is retrieved again: only query 3 is; stored grants that are gone are skipped.
    gone = corpus.filter("grant_id not in (0, 5)")
    second = K.retrieve_cached(ask, gone, cache, now, contains_scorer)
    by_hit = {(r.qid, r.cache_hit) for r in second.hits.select("qid", "cache_hit").distinct().collect()}
    assert by_hit == {(0, True), (1, True), (2, True), (3, False)}
    assert rows(second.hits.filter("qid < 3")) == [x for x in rows(first.hits) if x[2] not in (0, 5)]
    assert rows(second.hits.filter("qid = 3")) == rows(retrieve(ask, gone, score_fn=contains_scorer).hits.filter("qid = 3"))
    assert sorted(map(tuple, second.counts.filter("qid < 3").collect())) == sorted(map(tuple, first.counts.collect()))
    # The portal is part of an entry's identity.
    other = ask.filter("qid = 2").withColumn("portal", F.lit("p2"))
    assert not K.retrieve_cached(other, corpus, cache, now, contains_scorer).hits.filter("cache_hit").count()
