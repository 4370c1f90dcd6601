from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from subventa.functions import labels as L
from subventa.functions import text as X
from subventa.functions import trigram as G
from subventa.functions import vectors as V


def apply(spark, values, kind, fn):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").select("i", fn(F.col("v")).alias("o"))
    return [r["o"] for r in df.orderBy("i").collect()]


AMOUNTS = [
    ("€ 1.500.000", "1500000"),
    ("EUR 500.000", "500000"),
    ("1,5 Mio. €", "1500000"),
    ("2,5 Mrd. EUR", "2500000000"),
    ("500 thousand EUR", "500000"),
    ("3 million EUR", "3000000"),
    ("500k EUR", "500000"),
    ("3000", "3000"),
    ("3.000", "3000"),
    ("1.234,56 €", "1234.56"),
    ("", None),
    (None, None),
    ("xyz", None),
    ("--", None),
    ("500 000 €", "500"),
    ("€1,000,000", None),
    ("200.000.", None),
    ("1,500.00", "1.5"),
    ("100 Tsd. Euro", "100000"),
    ("5 kg", "5"),
    ("9" * 40, None),
]


def test_amounts(spark):
    got = apply(spark, [a for a, _ in AMOUNTS], "string", X.parse_amount_eur)
    assert got == [None if v is None else Decimal(v) for _, v in AMOUNTS]


# Each form as lower() leaves it decides: the Kelvin sign is a k, dotless i and long s are no ASCII letters.
CASED_AMOUNTS = [
    ("1 MIO. EUR", "1000000"), ("1 MıO", "1"), ("1 MİO", "1"), ("2 MILLIARDEN", "2000000000"), ("2 MiLLioN", "2000000"),
    ("3 TSD.", "3000"), ("3 tſd", "3"), ("4K", "4000"), ("4\u212a EUR", "4000"), ("4kg", "4"), ("4 kÉ", "4"), ("4 K\u00a0EUR", "4000"),
    ("5\u00a0\u2003Mrd", "5000000000"), ("\u0663 THOUSAND", "3000"), ("\U0001d7d1 Mio", None),
    (".5", "0.5"), ("5.", "5"), (".", None), ("a, 7", None), ("1.2.3", None), ("..5", None), ("1.234.567 k", "1234567000"), ("5 x mio", "5"),
]


def test_amounts_in_either_case(spark):
    got = apply(spark, [a for a, _ in CASED_AMOUNTS], "string", X.parse_amount_eur)
    assert got == [None if v is None else Decimal(v) for _, v in CASED_AMOUNTS]
    matches = apply(spark, ["bis 4 MIO. Euro", "4\u212a", "nichts", None], "string", X.amount_match)
    assert matches == ["4 mio.", "4k", "", None]


DATES = [
    ("15. März 2026", (2026, 3, 15)),
    ("1 Mai 2025", (2025, 5, 1)),
    ("31. Dezember 2026", (2026, 12, 31)),
    ("31.12.2026", (2026, 12, 31)),
    ("01/06/2025", (2025, 6, 1)),
    ("2026-03-15", (2026, 3, 15)),
    ("Antragsfrist ist der 15. März 2026 um 23:59", (2026, 3, 15)),
    ("", None),
    ("not a date", None),
    ("32. März 2026", None),
    ("15. Wurst 2026", None),
    ("30.02.2026, sonst 15. März 2026", None),
    ("0000-01-01", None),
    ("3.\n Sept­ 2024", (2024, 9, 3)),
]


def test_dates(spark):
    got = apply(spark, [d for d, _ in DATES], "string", X.parse_german_date)
    assert got == [None if v is None else datetime(*v) for _, v in DATES]


def test_whitespace(spark):
    values = ["  Hallo\n\tWelt  ", "Soft­hyphen", "multi    space\n\n\nlines", "", None, "a \x1cb "]
    assert apply(spark, values, "string", X.normalize_whitespace) == [
        "Hallo Welt", "Softhyphen", "multi space lines", "", "", "a b",
    ]


def test_content_hash_ignores_nothing_but_nulls(spark):
    import hashlib

    row = spark.range(1).select(
        X.content_hash(*[F.lit(v).cast("string") for v in ("t", "s", "b", None, "DE", None)]).alias("h")
    ).first()
    assert row["h"] == hashlib.sha256("t|s|b||DE|".encode()).hexdigest()


def test_embedding_tasks(spark):
    texts = ["query: foo", "passage: bar", "plain"]
    assert apply(spark, texts, "string", X.embedding_task) == ["RETRIEVAL_QUERY", "RETRIEVAL_DOCUMENT", "RETRIEVAL_DOCUMENT"]
    assert apply(spark, texts, "string", X.without_task_prefix) == ["foo", "bar", "plain"]
    keys = apply(spark, ["query: same", "passage: same"], "string", lambda c: X.embedding_key(X.embedding_task(c), X.without_task_prefix(c)))
    assert keys[0] != keys[1]


def test_scrub(spark):
    values = ["https://x.test/m?key=AIza_9-x&alt=sse", "a&key=abc b", "no secret"]
    assert apply(spark, values, "string", X.scrub_secrets) == [
        "https://x.test/m?key=<redacted>&alt=sse", "a?key=<redacted> b", "no secret",
    ]


def test_hypotheticals(spark):
    values = [
        '{"descriptions":[" abc ", 3, ""]}',
        '["x","y"]',
        '```json\n{"descriptions":["q"]}\n```',
        "- this is a long line with words\nshort\n* another long line with words *",
        "",
        None,
        "5",
        '{"a":1}',
        '{"descriptions":"x"}',
    ]
    assert apply(spark, values, "string", X.hypothetical_descriptions) == [
        ["abc"], ["x", "y"], ["q"], ["this is a long line with words", "another long line with words"], [], [], [], [], [],
    ]


def test_labels(spark):
    fits = ["High", " h ", "highly", "MEDIUM", "med", "m", "low", None, "?"]
    assert apply(spark, fits, "string", L.fit_label) == ["high"] * 3 + ["medium"] * 3 + ["low"] * 3
    sev = ["High", "critical", "BLOCKER", "med", "Moderate", None, "minor"]
    assert apply(spark, sev, "string", L.severity) == ["high"] * 3 + ["medium"] * 2 + ["low"] * 2
    scores = ["2.5", "3.5", "abc", None, "150", "-3", "nan", "87.6"]
    assert apply(spark, scores, "string", L.clamp_score) == [2, 4, 0, 0, 100, 0, 0, 88]


def test_cost(spark):
    row = spark.range(1).select(L.token_cost_usd(F.lit(1_000_000), F.lit(2_000_000)).alias("c")).first()
    assert row["c"] == pytest.approx(0.675)


def test_deadline_buckets(spark):
    as_of = F.lit("2026-01-01 12:00:00").cast("timestamp")
    values = [None, "2025-12-31 00:00:00", "2026-01-01 00:00:00", "2026-01-31 12:00:00", "2026-02-01 00:00:00"]
    got = apply(spark, values, "string", lambda c: L.deadline_bucket(c.cast("timestamp"), as_of))
    # half a day ago rounds to zero days, 30.5 days round to 31
    assert got == ["rolling", "closed", "closing_soon", "closing_soon", "later"]


def test_vectors(spark):
    assert apply(spark, [[3.0, 4.0], [0.0, 0.0]], "array<double>", V.l2_normalise) == [[0.6, 0.8], [0.0, 0.0]]
    import hashlib

    vec = [0.5, -0.25, -1.5, 0.999]
    want = hashlib.sha256(bytes(int((x + 1.0) * 32767) % 65536 // 256 for x in vec)).hexdigest()[:24]
    assert apply(spark, [vec], "array<double>", V.quantised_key) == [want]


def reference_grams(text):
    import re

    out = set()
    for w in re.split(r"[\W_]+", text.lower()):
        if w:
            p = f"  {w} "
            out |= {p[i : i + 3] for i in range(len(p) - 2)}
    return out


def test_trigrams(spark):
    texts = ["foo bar-a", "", "...", "ein Gründer, zwei 2024 x", "__under__score__"]
    got = apply(spark, texts, "string", G.trigrams)
    assert [set(g) for g in got] == [reference_grams(t) for t in texts]
    assert all(len(g) == len(set(g)) for g in got)
