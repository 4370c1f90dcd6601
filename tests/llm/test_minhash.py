import random
import re

import pytest

from subventa.llm import minhash
from subventa.llm.minhash import near_duplicates, one_of_each

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def brute(rows, percent=85, width=3):
    sets = []
    for _, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        grams = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)] or ([tuple(words)] if words else [])
        sets.append(set(grams))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    index = {}
    for i, s in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        common = {}
        for g in s:
            for j in index[g]:
                if j > i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(j)] = root(i)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc)
    least = {k: min(v) for k, v in groups.items()}
    return sorted((doc, len(sets[i]), least[root(i)], doc == least[root(i)]) for i, (doc, _) in enumerate(rows))


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(near_duplicates(docs, 85, 3)) == brute(rows)


def test_chains_of_edits_equal_brute_force(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(25):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([12, 60, 150]))]
        for _ in range(rng.choice([1, 4, 12])):
            words = list(words)
            for _ in range(rng.choice([0, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((n, " ".join(words)))
            n += 1
    rng.shuffle(rows)
    assert got(near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), 85, 3)) == brute(rows)


def test_blocks_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 5)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 3000)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for n in range(60):
        words = list(base)
        for _ in range(rng.choice([3, 4, 5, 6])):
            words[rng.randrange(90)] = f"y{rng.randrange(10**6)}"
        rows.append((n, " ".join(words)))
    assert got(near_duplicates(spark.createDataFrame(rows, SCHEMA), 85, 3)) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE\x0bTWO"), (8, "Été é"), (9, "été é"),
            (10, long), (11, long + " tail"), (12, "a b c a b c a b c"), (12, "a b c a b c a b c")]
    assert got(near_duplicates(spark.createDataFrame(rows, SCHEMA), 85, 3)) == brute(rows)


def test_null_ids_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "q r s t")], SCHEMA)
    df = df.selectExpr("*", "1 as node", "2 as Bands", "3 as component")
    out = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(df, 85, 3).collect()}
    assert out == {(None, 5, False), (5, 5, True), (None, None, True)}
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("percent", [50, 95])
def test_other_thresholds(spark, percent):
    rng = random.Random(percent)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for n in range(40):
        words = list(base)
        for _ in range(rng.randrange(8)):
            words[rng.randrange(80)] = f"y{rng.randrange(10**6)}"
        rows.append((n, " ".join(words)))
    assert got(near_duplicates(spark.createDataFrame(rows, SCHEMA), percent=percent, width=3)) == brute(rows, percent)


def test_one_of_each_keeps_columns_and_rows(spark):
    same = " ".join(f"w{i}" for i in range(60))
    rows = [(3, same), (1, same + " x"), (2, "other words here at all"), (2, "other words here at all"), (None, "no id at all"), (None, same), (4, None), (5, "")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "7 as kept", "8 as _key")
    out = sorted(((r.doc_id, r.text, r.kept, r["_key"]) for r in one_of_each(df).collect()), key=repr)
    assert out == sorted([(None, same, 7, 8), (2, "other words here at all", 7, 8), (None, "no id at all", 7, 8), (4, None, 7, 8), (5, "", 7, 8)], key=repr)
