import numpy as np
import pytest
from pyspark.sql import functions as F

from subventa.functions.trigram import trigrams
from subventa.operators import similarity_join as J
from subventa.operators.sparse import sparse_top_k
from tests.test_functions import reference_grams

WORDS = "grant loan small business founder health digital über straße energy climate research 日本 a b c x1".split()


def texts(n, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS, rng.integers(0, 7))) for _ in range(n)]


def sides(spark, left, right):
    a = spark.createDataFrame(list(enumerate(left)), "l_id long, t string").select("l_id", trigrams(F.col("t")).alias("grams"))
    b = spark.createDataFrame(list(enumerate(right)), "r_id long, t string").select("r_id", trigrams(F.col("t")).alias("grams"))
    return a, b


def brute(left, right, threshold):
    out = {}
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            a, b = reference_grams(x or ""), reference_grams(y or "")
            if a | b and len(a & b) / len(a | b) >= threshold and a & b:
                out[i, j] = len(a & b) / len(a | b)
    return out


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.5, 0.8, 1.0])
def test_equals_all_pairs(spark, threshold):
    left, right = texts(60, 1) + ["", None, "grant"], texts(150, 2) + ["", None, "grant", "grant"]
    a, b = sides(spark, left, right)
    got = {(r.l_id, r.r_id): r.score for r in J.similarity_join(a, b, threshold).collect()}
    assert got == pytest.approx(brute(left, right, threshold))


def test_small_cells_give_the_same(spark):
    left, right = texts(80, 3), ["grant loan"] * 60 + texts(60, 4)
    a, b = sides(spark, left, right)
    whole = {(r.l_id, r.r_id) for r in J.similarity_join(a, b, 0.4).collect()}
    assert whole == set(brute(left, right, 0.4))
    assert {(r.l_id, r.r_id) for r in J.similarity_join(a, b, 0.4, cell_rows=7).collect()} == whole


def test_pairs_without_a_shared_prefix_gram_never_meet(spark):
    """Sets that share common grams alone: as many candidates as there are similar pairs, not left times right."""
    left = [f"common words here {w * 6}" for w in ("qa", "wb", "ec", "rd", "tf")]
    right = [f"common words here {w * 6}" for w in ("ug", "ih", "oj", "pk", "al", "qa")]
    a, b = sides(spark, left, right)
    met = {(r.l_id, r.r_id) for r in J.candidates(J.coded(a), J.coded(b), 0.8).collect()}
    assert met == {(0, 5)} == set(brute(left, right, 0.8))


def test_rare_grams_are_not_copied(spark):
    a, b = sides(spark, texts(500, 5), texts(40, 6))
    a, b = J.coded(a), J.coded(b)
    counts, asked = J.gram_counts(b), J.gram_counts(a)
    one = np.ones_like(counts)
    rows = J._prefixes(b, counts + asked, one, one, 0.3, "r_cell", "l_cell")
    grams = sum(len(reference_grams(t)) for t in texts(40, 6))
    assert 0 < rows.count() <= grams  # whatever the number of queries


def test_conditions_empty_sides_and_thresholds(spark):
    a, b = sides(spark, ["small loan", "small loan"], ["small loan", "small loans"])
    a, b = a.withColumn("l_x", F.col("l_id")), b.withColumn("r_x", F.col("r_id"))
    got = J.similarity_join(a, b, 0.5, F.col("l_x") == F.col("r_x")).collect()
    assert {(r.l_id, r.r_id) for r in got} == {(0, 0), (1, 1)}
    assert J.similarity_join(a.limit(0), b, 0.5).count() == 0 and J.similarity_join(a, b.limit(0), 0.5).count() == 0
    with pytest.raises(ValueError):
        J.similarity_join(a, b, 0.0)


def test_search_by_join_keeps_filters(spark):
    docs = [(i, t, " ".join(reversed(t.split())), f"p{i % 3}", "DE" if i % 2 else "EU") for i, t in enumerate(texts(120, 7))]
    corpus = spark.createDataFrame(docs, "grant_id long, title string, summary string, portal string, country string").withColumn("deleted_at", F.when(F.col("grant_id") == 5, F.lit("2026-01-01").cast("timestamp")))
    asked = [(i, t, None if i % 2 else "p1", None if i % 3 else "de") for i, t in enumerate(texts(30, 8))]
    queries = spark.createDataFrame(asked, "qid long, query string, portal string, country string")
    scan = sparse_top_k(queries, corpus, 5).collect()
    assert scan and sorted(scan) == sorted(sparse_top_k(queries, corpus, 5, max_broadcast_grams=0).collect())


def test_common_grams_bring_no_pairs_into_the_join(spark):
    """Sets that share grams with many others meet in cells: none of their pairs is handed on but similar ones."""
    rng = np.random.default_rng(9)
    many = [" ".join(rng.choice(WORDS, 6)) + f" {i % 40}" for i in range(300)]
    a, b = sides(spark, many, many)
    assert J.candidates(J.coded(a), J.coded(b), 0.6, cell_rows=20).count() <= 20 * len(set().union(*map(reference_grams, many)))
    for threshold in (0.3, 0.7):
        got = {(r.l_id, r.r_id): r.score for r in J.similarity_join(a, b, threshold, cell_rows=20).collect()}
        assert got == pytest.approx(brute(many, many, threshold))


@pytest.mark.parametrize("threshold", [0.3, 0.7, 1.0])
def test_sets_joined_with_themselves_give_each_pair_once(spark, threshold):
    """The ids do not ascend with the sizes, so either set of a pair may be the smaller one."""
    many = texts(90, 10) + [" ".join(np.random.default_rng(i).choice(WORDS, 6)) + f" {i % 40}" for i in range(90)] + ["", None, "grant"]
    a, _ = sides(spark, many, [])
    wanted = {(i, j): s for (i, j), s in brute(many, many, threshold).items() if i < j}
    for cell_rows in (20, J.CELL_ROWS):
        got = J.similarity_join(a, None, threshold, cell_rows=cell_rows).collect()
        assert len(got) == len(wanted)
        assert {(r.l_id, r.r_id): r.score for r in got} == pytest.approx(wanted)
    with pytest.raises(ValueError):
        J.similarity_join(a, None, threshold, F.col("l_id") < 5)


def test_sets_of_many_blocks_are_written_once(spark, monkeypatch, tmp_path):
    """However many blocks a set meets, no copy of it is stored or shuffled."""
    monkeypatch.setattr(J, "shared_path", lambda _, name: f"{tmp_path}/{name}")
    rng = np.random.default_rng(11)
    many = [" ".join(rng.choice(WORDS, 6)) + f" {i % 40}" for i in range(200)]
    a, b = sides(spark, many, many)
    J.similarity_join(a, b, 0.6, cell_rows=20)
    for side in ("l", "r"):
        hot = spark.read.parquet(f"{tmp_path}/marked-{side}").filter(f"{side}_hot")
        blocks = spark.read.parquet(f"{tmp_path}/blocks-{side}")
        assert blocks.count() > 8
        assert 100 < blocks.agg(F.sum(F.size("rows"))).head()[0] == hot.count()
    close = J._by_blocks(*(spark.read.parquet(f"{tmp_path}/marked-{side}") for side in ("l", "r")), 0.6, 20)
    plan = close._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_blocks_of_many_different_grams(spark, monkeypatch):
    """More grams than sixteen bits number, in one block."""
    monkeypatch.setattr(J, "_GRAMS_PER_ROW", 10**6)
    monkeypatch.setattr(J, "_LEAST_PART", 1)
    rng = np.random.default_rng(12)
    many = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 420))) for _ in range(170)]
    many += [t[: 400 - 3 * i] for i, t in enumerate(many[:20])]
    assert len(set().union(*map(reference_grams, many))) > 1 << 16
    a, b = sides(spark, many, many)
    wanted = brute(many, many, 0.8)
    assert len(wanted) > len(many) + 20
    assert {(r.l_id, r.r_id): r.score for r in J.similarity_join(a, b, 0.8, cell_rows=1).collect()} == pytest.approx(wanted)


@pytest.mark.parametrize("words", [2, 4, 16])
def test_sketches_never_tell_similar_sets_apart(words):
    rng = np.random.default_rng(13)
    sets = [{int(x) << 42 | int(y) << 21 | int(z) for x, y, z in rng.integers(97, 103, (60, 3))} for _ in range(40)]
    sizes = np.array([len(s) for s in sets])
    whole = J._sketches(np.array([c for s in sets for c in s]), sizes, 4 * words)
    folded = J._folded(whole, words)
    for bits in (whole, folded):
        apart = np.bitwise_count(bits[:, None] ^ bits[None]).sum(axis=2)
        assert all(apart[i, j] <= len(a ^ b) for i, a in enumerate(sets) for j, b in enumerate(sets))
    # Grams that only their first characters tell apart do not fall into the same places.
    first = J._sketches(np.array([i << 42 | 98 << 21 | 99 for i in range(64)]), np.ones(64, np.int64), words)
    assert len(np.unique(first, axis=0)) > 32
