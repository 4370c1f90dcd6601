import random

import numpy as np

from subventa.llm import subspace
from subventa.llm.subspace import near_vectors

SCHEMA = "vec_id long, embedding array<double>, label string"


def brute(rows, cosine=0.98):
    ok = [i for i, (v, e, l) in enumerate(rows) if v is not None and l is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links = {i: set() for i in range(len(rows))}
    for n, i in enumerate(ok):
        for j in ok[n + 1 :]:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if rows[i][2] == rows[j][2] and len(a) == len(b) and (rows[i][1] == rows[j][1] or a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine):
                links[i].add(j)
                links[j].add(i)
    out = []
    for i, (v, *_rest) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((v, len(links[i]), least, v == least))
    return sorted(out, key=repr)


def got(df, **settings):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(df, **settings).collect()), key=repr)


def clusters(seed, n, dims, noise):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        centre = rng.standard_normal(dims)
        for _ in range(int(rng.integers(1, 12))):
            rows.append([(centre + noise * rng.standard_normal(dims)) * rng.choice([1.0, 3.0]), str(c % 3)])
    random.Random(seed).shuffle(rows)
    return [(i, [float(x) for x in e], label) for i, (e, label) in enumerate(rows)]


def test_clusters_equal_brute_force(spark):
    for seed, dims, noise in [(1, 64, 0.14), (2, 64, 0.2), (3, 5, 0.15), (4, 19, 0.14)]:
        rows = clusters(seed, 30, dims, noise)
        assert got(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute(rows)


def test_pieces_of_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(subspace, "PIECE", 7)
    rows = clusters(9, 6, 16, 0.1)
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_odd_rows(spark):
    e = [1.0, 2.0, 3.0]
    rows = [(1, e, "a"), (2, e, "a"), (2, e, "a"), (3, e, None), (4, None, "a"), (5, [], "a"), (6, [0.0, 0.0, 0.0], "a"), (7, [1.0, None, 3.0], "a"), (8, [1.0, float("nan"), 3.0], "a"),
            (9, [1.0, float("inf"), 3.0], "a"), (10, [1.0, 2.0], "a"), (None, e, "a"), (11, [2.0, 4.0, 6.0], "a"), (12, e, "b")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as node", "2 as weight", "3 as cell")
    assert got(df) == brute(rows)
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_small_and_large_components(spark):
    """The size of a vector does not matter: links are those of the same vectors near size 1."""
    rows = clusters(6, 12, 8, 0.12)
    sizes = [1.0, 2.0**-560, 2.0**-900, 2.0**600, 2.0**1000]
    scaled = [(i, [x * sizes[i % 5] for x in e], label) for i, e, label in rows]
    assert got(spark.createDataFrame(scaled, SCHEMA)) == brute(rows)
    one = [(1, [5e-324, 0.0], "a"), (2, [1e308, 0.0], "a"), (3, [1e308, 1e308], "a")]
    assert got(spark.createDataFrame(one, SCHEMA)) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
