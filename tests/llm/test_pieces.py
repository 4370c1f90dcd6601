import functools
import random

import numpy as np
import public_tokenizers
import pytest

from subventa.llm.pieces import MARK, Model, decoded, encoded, segmentations

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def model():
    return Model(public_tokenizers.path("piece_bpe_32k.model"))


def all_paths(model, text):
    """Every segmentation of a short text as (score, ids), by plain recursion."""
    marked = MARK + text.replace(" ", MARK)

    @functools.cache
    def tails(at):
        if at == len(marked):
            return [(0.0, ())]
        out = []
        for end in range(at + 1, len(marked) + 1):
            found = model.pieces.get(marked[at:end])
            if found:
                out += [(found[1] + s, (found[0], *ids)) for s, ids in tails(end)]
        if marked[at] not in model.pieces:
            own = tuple(model.byte_ids[b] for b in marked[at].encode())
            out += [(model.unknown + s, (*own, *ids)) for s, ids in tails(at + 1)]
        return out

    return tails(0)


@pytest.mark.parametrize("n", [1, 3, 6])
def test_equal_to_all_paths(model, n):
    rng = random.Random(n)
    parts = ["the", "an", "tion", " ", " ", "  ", "x", "é", "一", "\n", "\U0001f9ff", "ing", "ß"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(60)] + ["", " ", "   ", "a"]
    for text, got in zip(texts, encoded(texts, model, n, {})):
        want = sorted(all_paths(model, text), key=lambda x: -x[0]) if text else [(0.0, ())]
        assert np.allclose([s for s, _ in got], [s for s, _ in want[:n]], rtol=1e-12)
        by_ids = {ids: s for s, ids in want}
        assert len({tuple(i.tolist()) for _, i in got}) == len(got)
        for score, ids in got:
            assert np.isclose(by_ids[tuple(ids.tolist())], score, rtol=1e-12)
            assert model.decode(ids.astype(np.int64)).decode() == text


def test_long_chunk_equals_one_by_one(model):
    rng = random.Random(4)
    text = "".join(rng.choice("thernaio") for _ in range(400)) + " " + "".join(rng.choice("ab一") for _ in range(60))
    ((best, ids), *_rest) = encoded([text], model, 4, {})[0]
    chunks = [model.best_paths(c, 4) for c in (MARK + text.split(" ")[0], MARK + text.split(" ")[1])]
    assert np.isclose(best, sum(c[0][0] for c in chunks)) and ids.tolist() == chunks[0][0][1] + chunks[1][0][1]


def test_paths_look_up_no_further_than_a_piece_begins(model):
    class Counted(dict):
        looked = 0

        def get(self, *args):
            Counted.looked += 1
            return super().get(*args)

    own = Model.__new__(Model)
    own.__dict__ |= model.__dict__ | {k: Counted(v) for k, v in model.__dict__.items() if isinstance(v, dict)}
    chunk = MARK + "xq" * 100
    assert own.best_paths(chunk, 4) == model.best_paths(chunk, 4)
    assert 0 < Counted.looked <= 4 * len(chunk)


def test_documents_round_trip_and_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = segmentations(docs, 4)
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = decoded(rows).collect()
    assert {r.doc_id for r in found} == set(texts)
    best = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        assert r.decoded and r.text == texts[r.doc_id]
        assert r.score <= best.get(r.doc_id, 0.0) + 1e-9
        best[r.doc_id] = r.score


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "same"), (3, "same"), (None, "x y"), (4, "w" * 5000), (5, "a ▁ b"), (6, " lead and trail ")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as ids", "2 as rank", "3 as decoded")
    got = segmentations(df).collect()
    assert all(r.decoded for r in got)
    assert sum(r["rank"] == 0 for r in got) == len(rows)
    assert segmentations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert decoded(spark.createDataFrame([(1, None)], "k int, ids binary")).first().text is None
