import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from subventa.llm.packing import combinations, packed, plan, repeat_counts

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def check(df, rows, window=1024, padding=None):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for doc, text in rows:
        ids.setdefault(doc, []).append(tok.encode(text or "", add_special_tokens=False).ids + [0])
    got = df.collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(ids)
    for doc, pieces in by_doc.items():
        assert sum(p.length for p in pieces) == sum(map(len, ids[doc]))
        if len(ids[doc]) == 1:
            (own,) = ids[doc]
            at = 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(own)
                assert p.ids_crc32 == zlib.crc32(np.array(own[at : at + p.length], "<u4").tobytes())
                at += p.length
    total = 0
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= window
        total += window - at
    if padding is not None:
        assert total <= padding * window * len(by_seq) + window
    return got


def test_documents_cut_into_full_sequences(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check(packed(docs), rows, padding=0.005)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x" * 50000), (4, " " * 20000), (5, "<|endoftext|> a"), (8, "a <|endoftext|><|endoftext|>\n\n<|endoftext|> <|endoftext"), (6, "same"), (6, "same"), (None, "a b"), (7, "é\U0001f600\n\t ")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as rest", "2 as Checks", "3 as length")
    check(packed(df), rows)
    assert packed(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_of_one_length(spark):
    rows = [(i, "word " * 300) for i in range(700)]
    check(packed(spark.createDataFrame(rows, SCHEMA)), rows, padding=0.005)


@pytest.mark.parametrize("n,top,seed", [(0, 9, 0), (1, 1023, 1), (400, 1023, 2), (3000, 500, 3), (3000, 1023, 4), (900, 6, 5)])
def test_plans_hold_every_rest_once(n, top, seed):
    counts = np.bincount(np.random.default_rng(seed).integers(1, top + 1, n), minlength=1024)
    patterns, stream = plan(counts)
    used = stream.copy()
    for lengths, repeats in patterns:
        assert 1020 <= sum(lengths) <= 1024
        np.add.at(used, list(lengths), repeats)
    assert (used == counts).all()


def test_repeat_counts_against_every_support():
    """Least squares over every set of combinations, the best one that is not negative."""
    rng = np.random.default_rng(7)
    for _ in range(15):
        counts = np.zeros(13, np.int64)
        counts[rng.choice(np.arange(1, 13), 6, replace=False)] = rng.integers(5, 400, 6)
        combos = combinations(counts, window=12, slack=1)[:9]
        table = np.array([[(c == k).sum() for c in combos] for k in range(1, 13)], float).reshape(12, len(combos))
        want = counts[1:].astype(float)
        best = float((want**2).sum())
        for chosen in range(1, 1 << len(combos)):
            part = table[:, [j for j in range(len(combos)) if chosen >> j & 1]]
            x = np.linalg.lstsq(part, want, rcond=None)[0]
            if (x >= -1e-9).all():
                best = min(best, float(((part @ x - want) ** 2).sum()))
        got = repeat_counts(combos, counts)
        assert (got >= 0).all()
        # Each coordinate stops within half a repeat of its best value.
        assert ((table @ got - want) ** 2).sum() <= best + 0.25 * (table.sum(axis=0) ** 2).sum() + 0.02 * (want**2).sum()


@pytest.mark.parametrize("top", [1_000, 2_000_000])
def test_plan_time_does_not_grow_with_the_counts(top):
    counts = np.random.default_rng(3).integers(0, top, 1024)
    counts[0] = 0
    start = time.perf_counter()
    patterns, stream = plan(counts)
    assert time.perf_counter() - start < 8
    used = stream.copy()
    for lengths, repeats in patterns:
        np.add.at(used, list(lengths), repeats)
    assert (used == counts).all() and stream.sum() <= 0.06 * counts.sum()
