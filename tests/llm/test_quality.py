import re

from subventa.llm import quality

SCHEMA = "doc_id long, text string"
GOOD = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} plain" for i in range(60))


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {g for g in set(grams) if grams.count(g) > 1} if len(grams) < 500 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    covered = {i + o for i, g in enumerate(grams) if g in again for o in range(3)}
    n_words, chars = len(words), sum(map(len, words))
    symbols, dups = len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    base = n_words < 50 or 100 * len(covered) > 50 * n_words
    others = sum(not c.isalpha() and c not in " \t\n\x0b\f\r" for c in text)
    shouts = sum(c.isupper() for c in text)
    bad = (100 * symbols > 6 * chars or 100 * others > 40 * chars or 100 * shouts > 50 * (chars - others) or 100 * text.count("!") > 25 * n_words
           or chars > 20 * n_words or chars < 2 * n_words or 100 * dups > 60 * len(lines))
    return n_words, chars, symbols, dups, len(covered), base, not base and not bad


ROWS = [
    (1, None), (2, ""), (3, " \n\t\x0b "), (4, GOOD), (4, GOOD), (5, GOOD.upper()), (6, GOOD.replace(" ", "!! ")), (7, GOOD.replace(" ", " | ")), (8, "a b c " * 40),
    (9, "one\nsame line\nsame line\n" + GOOD), (10, "\n".join(["x y z"] * 30)), (11, GOOD + "\r\nlast\x0bword\n"), (12, "é\U0001f600 " * 60), (None, GOOD), (13, " ".join(f"q{i} r" for i in range(20000))),
]


def test_measures_and_verdicts_equal_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 as _words", "2 as _Body", "3 as x")
    got = quality.judged(df).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert sorted((r.doc_id or -1, *(r[n] for n in names)) for r in got) == sorted((d or -1, *brute(t)) for d, t in ROWS)
    assert {(r["_words"], r["_Body"], r["x"]) for r in got} == {(1, 2, 3)}


def test_passing_keeps_the_same_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 as kept", "2 as n_words")
    out = quality.passing(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or -1, r.text) for r in out.collect()) == sorted((d or -1, t) for d, t in ROWS if brute(t)[-1])
    assert quality.passing(spark.createDataFrame([], SCHEMA)).count() == 0


def test_order_by_rejections_per_cost(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    found = quality.ordered_rules(df, quality.rules())
    rates = [hits / seconds for _, hits, seconds in found]
    assert rates == sorted(rates, reverse=True)
    names = [r.name for r in quality.rules()]
    assert sorted(r.name for r, _, _ in found) == sorted(names)


def test_plan_is_free_of_python(spark):
    plan = quality.judged(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
