import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from subventa.llm import importance as I

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    ws = WORD.findall((text or "").translate(LOWER))
    return [zlib.crc32(" ".join(ws[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(ws) - k + 1)], len(ws)


def brute(rows, target):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(grams(text)[0])
    for text in target:
        t.update(grams(text)[0])
    s_all, t_all = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in range(10_000)}
    out = []
    for doc, text in rows:
        found, n = grams(text)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    enough = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(enough[: 5 * len(enough) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def drawn(spark, rows, target):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as Rank", "3 as idx", "4 as n_words")
    got = I.resampled(df, spark.createDataFrame([(t,) for t in target], "text string").selectExpr("text", "0 as doc_id"))
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()), key=str)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    words = ["alpha", "Beta", "é", "x1", "ÜBER", "o'clock", "a-b", "日本", "q" * 90]
    rows = [(int(i), " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(300)]
    assert drawn(spark, rows, ["alpha x1 é", "beta beta", None, ""]) == brute(rows, ["alpha x1 é", "beta beta", None, ""])


def test_nulls_repeats_ties_long_texts(spark):
    long = "Very long text, " * 60_000 + "w" * 200_000
    rows = [(1, None), (2, ""), (3, "!?"), (4, "one"), (5, long), (None, "a b " * 12)] + [(9, "same words " * 15)] * 30 + [(10 + i % 2, "same words " * 15) for i in range(20)]
    assert drawn(spark, rows, ["same words"]) == brute(rows, ["same words"])


def test_empty_tables(spark):
    assert drawn(spark, [], ["a"]) == []
    rows = [(i, "a b c " * 10) for i in range(40)]
    assert drawn(spark, rows, []) == brute(rows, [])


def test_slices_do_not_matter():
    texts = ["End here", "", "begin There", "alone", "zwei  Wörter\tund mehr", "x"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    tables = I._shift_tables()
    found, n, words = I.feature_buckets(data, offsets, tables)
    assert [sorted(x) for x in np.split(found, np.cumsum(n)[:-1])] == [sorted(grams(t)[0]) for t in texts]
    assert words.tolist() == [grams(t)[1] for t in texts]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 1000, 123_457])
def test_shift_is_that_of_the_crc(n):
    head, tail = b"head of it", bytes(range(256)) * (n // 256) + bytes(n % 256)
    got = I.shifted(np.array([zlib.crc32(head)], np.uint32), np.array([n]), I._shift_tables())
    assert int(got[0]) ^ zlib.crc32(tail) == zlib.crc32(head + tail)
