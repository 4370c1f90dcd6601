from subventa.llm.templates import without_recurring

SCHEMA = "doc_id long, text string"


def left(spark, rows, **settings):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as row", "2 as _lines", "3 as kin")
    out = without_recurring(df, counts=("n", "dropped"), **settings)
    assert out.columns == ["doc_id", "text", "row", "_lines", "kin", "n", "dropped"]
    return {(r.doc_id, r.text, r.n, r.dropped) for r in out.collect()}


def own(i):
    words = "ab cd ef gh ij kl mn op qr st".split()
    return f"{words[i % 10]}x own opening of this very {words[i // 10 % 10]} one"


def test_exact_and_field_templates_are_dropped(spark):
    rows = [(i, f"{own(i)}\nPage {i} of 12{i} pages\nShared by all of them\n{own(i)} end") for i in range(6)]
    assert left(spark, rows) == {(i, f"{own(i)}\n{own(i)} end", 4, 2) for i in range(6)}


def test_variable_words_inside_a_leaf(spark):
    names = ["anna", "bert", "carl", "dora"]
    rows = [(i, f"{own(i)}\nThis page was written by {n} for the daily paper of town") for i, n in enumerate(names)]
    assert left(spark, rows) == {(i, own(i), 2, 1) for i in range(4)}
    unlike = [(i, f"{own(i)}\nThis page was {n} {n}s {n}t {n}u {n}v {n}w") for i, n in enumerate(names)]
    assert left(spark, unlike) == {(i, t, 2, 0) for i, t in unlike}


def test_copies_are_not_independent(spark):
    whole = "\n".join(own(i) + " body" for i in range(9))
    rows = [(i, whole) for i in range(20)] + [(100 + i, whole + f"\nedit {own(i)}") for i in range(8)]
    assert {t for _, t, _, d in left(spark, rows) if d} == set()


def test_rare_lines_and_short_ones_stay(spark):
    rows = [(1, "a b c d\nx"), (2, "a b c d\ny z"), (3, "One\nq r s"), (4, "One\nt u v"), (5, "One\nw w w"), (6, "One\nk k k")]
    assert left(spark, rows) == {(i, t, 2, 0) for i, t in rows}


def test_odd_rows(spark):
    long = "\n".join(f"line {own(i % 97)} {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(5000))
    shared = "all rights are reserved here"
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, long), (5, f"{own(1)}\n\n{shared}\t "), (5, f"{own(1)}\n\n{shared}\t "), (6, f"{shared}\n{own(2)}"), (None, f"{own(3)}\n  {shared}")]
    got = left(spark, rows)
    assert got == {(1, None, 0, 0), (2, "", 1, 0), (3, "\n\n", 3, 0), (4, long, 5000, 0), (5, f"{own(1)}\n", 3, 1), (6, own(2), 2, 1), (None, own(3), 2, 1)}
    assert left(spark, []) == set()


def test_texts_made_of_shared_templates_only(spark):
    rows = [(i, f"connection {i} closed by peer\npage {i * 7} was not found here") for i in range(40)]
    assert left(spark, rows) == {(i, "", 2, 2) for i in range(40)}


def spoken(i):
    return "".join(chr(97 + int(d)) for d in f"{i:03d}")


def field_rows(size):
    return [(i, f"{spoken(i)} opening of its own\nThe user account named {spoken(i // size)}x has opened a file called {spoken(i % size)}y on this host today") for i in range(size * size)]


def test_a_leaf_has_one_verdict_at_every_size(spark):
    for size in (2, 4, 12):
        rows = field_rows(size)
        assert left(spark, rows) == {(i, t.split("\n")[0], 2, 1) for i, t in rows}


def by_sql(rows):
    import duckdb
    import pandas as pd

    from subventa.llm.q_templates import SQL

    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841  (the SQL reads it)
    con = duckdb.connect()
    con.register("documents", documents)
    return {(d, t, n, k) for d, t, n, k in con.execute(f"SELECT doc_id, text, n_lines, n_dropped FROM ({SQL})").fetchall()}


def test_the_sql_states_the_same_rules(spark):
    named = [(i, f"{own(i)}\nThis page was written by {n} for the daily paper of town") for i, n in enumerate("anna bert carl dora".split())]
    logs = [(i, f"connection {i} closed by peer\npage {i * 7} was not found here") for i in range(40)]
    body = "\n".join(own(i) + " body" for i in range(9))
    copies = [(i, body) for i in range(20)] + [(100 + i, body + f"\nedit {own(i)}") for i in range(8)]
    for rows in (field_rows(2), field_rows(4), field_rows(8), named, logs, copies):
        assert left(spark, rows) == by_sql(rows)
