import random
import re

import numpy as np
import pytest

from subventa.llm import secrets as S
from subventa.llm import utf8

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def field():
    lines = S.made_lines(500)
    raws = [line.encode() for line, _ in lines]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raws])])
    return S.train(*S._tagged(np.frombuffer(b"".join(raws), np.uint8), offsets, [s for _, s in lines]))


def base(text):
    """Base spans by plain patterns over code points."""
    text = text or ""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        out += [("assign", m.start(), m.end())] if len(m[2]) >= 6 else []
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[1], S.KINDS.index(s[0])))


def found(df, field):
    return {(r.doc_id, tuple((s.kind, s.begin, s.end) for s in r.found)) for r in S.scanned(df, field).collect()}


def test_base_spans_of_documents(spark, field):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(d, tuple(s for s in spans if s[0] != "crf")) for d, spans in found(docs, field)}
    assert got == {(r.doc_id, tuple(base(r.text))) for r in docs.collect()}


def test_odd_rows(spark, field):
    key = "AKIA" + "ABCDEFGH12345678"
    texts = [None, "", "é\U0001f600 password=abc12345 é", "PASSWORD : 'short' token=\"abcdef\"", "ſecret=abcdef12 api_key:xyz12345", key, key[:-1], "x" + "a" * 23, "a" * 23 + "b", "f" * 5000,
             "token = token = abcdef1", "w " * 50000 + "passwd=zzzzzz99", "apikey==abcdefgh", "secret:\nabcdefgh"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (None, key)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as found")
    got = {(d, tuple(s for s in spans if s[0] != "crf")) for d, spans in found(df, field)}
    assert got == {(d, tuple(base(t))) for d, t in rows}
    assert S.scanned(spark.createDataFrame([], SCHEMA), field).count() == 0


def test_decoding_equals_full_search():
    rng = np.random.default_rng(2)
    for _ in range(200):
        sizes = rng.integers(0, 9, 4)
        first = np.concatenate([[0], np.cumsum(sizes)])
        scores, moves = rng.normal(size=(first[-1], 3)) * 3 - [0, 2, 2], rng.normal(size=(3, 3))
        tags = S.decode(scores, moves, first)
        for a, b in zip(first[:-1], first[1:]):
            value = lambda t: scores[np.arange(a, b), t].sum() + moves[t[:-1], t[1:]].sum()  # noqa: B023, E731
            best = max((value(np.array(np.unravel_index(i, (3,) * (b - a)))) for i in range(3 ** (b - a))), default=0) if b > a else 0
            assert b == a or np.isclose(value(tags[a:b].astype(int)), best)


def test_held_out_lines(field):
    hit = missed = wrong = 0
    for line, spans in S.made_lines(300, seed=41):
        data = np.frombuffer(line.encode(), np.uint8)
        starts, ends, first = utf8.words(data, np.array([0, len(data)]))
        tags = S.decode(field.scores(S.features(data, starts, ends, first)), field.moves, first)
        gold = np.zeros(len(starts), bool)
        for a, b in spans:
            gold |= (starts < b) & (ends > a)
        hit, missed, wrong = hit + (gold & (tags > 0)).sum(), missed + (gold & (tags == 0)).sum(), wrong + (~gold & (tags > 0)).sum()
    assert hit / (hit + missed) > 0.95 and hit / (hit + wrong) > 0.93


def test_field_adds_spans_patterns_miss(field):
    rng = random.Random(1)
    text = "the key is ghp_" + "".join(rng.choice(S._ALNUM) for _ in range(36)) + " here and nothing else"
    data = np.frombuffer(text.encode(), np.uint8)
    assert [k for _, _, k in S.spans_of(data, np.array([0, len(data)]), field)[0]] == [3]


def test_masked_replaces_spans_only(spark, field):
    df = spark.createDataFrame([(1, "é a password=abc12345 b"), (2, None), (3, "clean words only")], SCHEMA).selectExpr("*", "4 as n")
    assert {(r.doc_id, r.text, r.n) for r in S.masked(df, field=field).collect()} == {(1, "é a [SECRET] b", 4), (2, None, 4), (3, "clean words only", 4)}


def test_field_adds_what_base_spans_leave(field, monkeypatch):
    # Every token is one secret, so that only the cut by base spans shows.
    monkeypatch.setattr(S, "decode", lambda scores, moves, first: np.where(np.isin(np.arange(len(scores)), first), 1, 2).astype(np.int8))
    run = "0123456789abcdef01234567"
    for text, rest in [("password=hunter22!rest-of-it", ["!rest-of-it"]), (f"Zk9Q{run}Xy7Z", ["Zk9Q", "Xy7Z"]), ("token: Bearer eyJabc.def", ["eyJabc.def"]), ("password=hunter22", [])]:
        data = np.frombuffer(text.encode(), np.uint8)
        spans = S.spans_of(data, np.array([0, len(data)]), field)[0]
        assert [text[a:b] for a, b, k in spans if k == 3] == rest
        assert [s for s in spans if s[2] < 3] == S.base_spans(text.encode())


def test_many_spans_in_one_text(field):
    """Spans as plain patterns find them, in time that grows with the text."""
    import time

    text = "é password=abcd1234!Zx9q " * 20_000
    start = time.perf_counter()
    data = np.frombuffer(text.encode(), np.uint8)
    spans = S.spans_of(data, np.array([0, len(data)]), field)[0]
    begins = S._points(data, [a for a, _, _ in spans])
    assert time.perf_counter() - start < 5
    assert [b for b, (_, _, k) in zip(begins, spans) if k < 3] == [a for _, a, _ in base(text)]


def test_uncovered_parts():
    rng = random.Random(4)
    for _ in range(300):
        spans = sorted((a, a + rng.randint(1, 8), 0) for a in (rng.randrange(40) for _ in range(rng.randint(0, 6))))
        a = rng.randrange(45)
        b = a + rng.randint(1, 30)
        got = S._uncovered(a, b, *S._merged(spans))
        free = [x for x in range(a, b) if not any(s <= x < e for s, e, _ in spans)]
        assert [x for s, e in got for x in range(s, e)] == free and all(s < e for s, e in got)


def test_field_does_not_depend_on_files(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, many = S.trained(docs.repartition(1)), S.trained(docs.repartition(11))
    assert all(np.array_equal(np.asarray(a), np.asarray(b)) for a, b in zip(vars(one).values(), vars(many).values()))
