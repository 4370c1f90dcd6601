import unicodedata

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from subventa.llm import token_counts as T

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vocabulary():
    return T.Vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def wanted(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_documents_as_the_library_counts_them(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r for r in T.token_counts(docs).collect()}
    assert len(got) == len(rows)
    for r, n in zip(rows, wanted(library, [r.text for r in rows])):
        found = got[r.doc_id]
        assert (found.n_bytes, found.n_tokens, found.over_limit) == (len(r.text.encode()), n, n > 2048)


ODD = [
    "", " \n\t", "I'm you're they'VE 'll ''s !'s it's's 'sam 'rest 'vex' don't'", "aaaaaaaaaaaaaaaaaaaaa aaaa", "x<|endoftext|>y<|startoftext|><|endoftext|>",
    "<|endoftext|", "ΟΔΟΣ ΟΔΟΣ. ΑΣ", "İstanbul ǅ ß ẞ", "é ̈́ Ω 각", "12345 ½ Ⅷ ٣٤", "naïve—café…“quoted”", "😀👍🏽‍♀️", "\x1c\x1d\x85\xa0　z",
    "\U0001fae9 Ᲊa Ɤ", "'s" * 40, "don" * 900, "ab" * 3000 + "'re" + "c" * 5000, "͸ mixed with known words", "日本語のテキスト。漢字", "\x00\x01a", "e<|endoftext|>́",
]


def test_odd_texts(vocabulary, library):
    assert T.counted(ODD, vocabulary).tolist() == wanted(library, ODD)
    assert T.counted([], vocabulary).tolist() == [] and T.counted(["", ""], vocabulary).tolist() == [0, 0]


def test_every_code_point_in_words_and_alone(vocabulary, library):
    known = [chr(p) for p in range(0x110000) if unicodedata.category(chr(p)) not in ("Cs", "Cn", "Co")]
    texts = ["".join(f"a{c}b {c}1{c}'s" for c in known[i : i + 50]) for i in range(0, len(known), 50)]
    assert T.counted(texts, vocabulary).tolist() == wanted(library, texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abestr'lvm dLV1 2é́.,!ΣσÅ\n"), max_size=60), max_size=5))
def test_random_texts(vocabulary, library, texts):
    assert T.counted(texts, vocabulary).tolist() == wanted(library, texts)


def test_heap_and_rounds_agree(vocabulary):
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 50, 900):
        raw = rng.choice(np.frombuffer(b"etaoinshr", np.uint8), n)
        symbols = vocabulary.inner[raw]
        symbols[-1] = vocabulary.last[raw[-1]]
        assert vocabulary.survivors(symbols, np.array([n])).tolist() == [vocabulary._long(symbols)]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(T.utf8, "span_hashes", lambda data, b, e: np.zeros(len(b), np.uint64))
    data = np.frombuffer(b"abcabdabcxy", np.uint8)
    begins, ends = np.array([0, 3, 6, 9]), np.array([3, 6, 9, 11])
    lead, which = T._unique(data, begins, ends)
    assert [data[begins[lead[w]] : ends[lead[w]]].tobytes() for w in which] == [b"abc", b"abd", b"abc", b"xy"]


def test_nulls_repeats_long_texts_and_clashing_columns(spark, library):
    long = "Words' of a very long text, " * 40_000 + "z" * 30_000
    rows = [(1, None), (2, ""), (3, "same"), (3, "same"), (None, "a b"), (4, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as Over_Limit")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in T.token_counts(df).collect())
    n = wanted(library, [long])[0]
    assert got == [(0, 3, 2, False), (1, 0, 0, False), (2, 0, 0, False), (3, 4, 1, False), (3, 4, 1, False), (4, len(long), n, True)]
    assert T.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
