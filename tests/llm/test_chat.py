import random
import re

from subventa.llm.chat import conversations_of, read_back
from subventa.llm.q_chat import SQL, op4_chat_format

SCHEMA = "tree_id long, node_id long, parent_id long, role string, text string, score double"


def brute(rows, top=None):
    nodes = {}
    for t, n, p, role, text, score in rows:
        if t is not None and n is not None:
            nodes[(t, n)] = (p, role or "", text or "", score or 0.0)
    parents = {(t, p) for (t, n), (p, *_) in nodes.items() if (t, p) in nodes}
    branches = {}
    for t, n in nodes:
        if (t, n) in parents:
            continue
        path, at, seen = [], n, set()
        while (t, at) in nodes and at not in seen:
            seen.add(at)
            path.append(nodes[(t, at)])
            at = path[-1][0]
        score = sum(x[3] for x in path) / len(path)
        branches.setdefault(t, []).append((-score, n, [(x[1], x[2]) for x in reversed(path)]))
    return {(t, n): (rank, turns) for t, own in branches.items() for rank, (_, n, turns) in enumerate(sorted(own)) if top is None or rank < top}


def got(df):
    return {(r.tree_id, r.leaf): (r["rank"], [(a, b) for a, b, _, _ in read_back(r.formatted)]) for r in df.collect()}


def test_trees_equal_brute_force(spark):
    rng = random.Random(1)
    marks = ["\\", "###", "</turn>", "### A: ", ":", "x", "\n", "é", "####", "\\\\</turn>"]
    rows = []
    for t in range(12):
        for n in range(rng.choice([1, 3, 20, 60])):
            parent = rng.choice([None, 999]) if n == 0 else rng.choice([n - 1, rng.randrange(n)])
            rows.append((t, n, parent, rng.choice(["user", "assistant", "a:b", "\\", None]), "".join(rng.choice(marks) for _ in range(rng.randrange(6))), rng.randrange(4) * 0.25))
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(conversations_of(df)) == brute(rows)
    assert got(conversations_of(df, top=2)) == brute(rows, 2)


def test_odd_rows(spark):
    rows = [(1, 1, None, None, None, None), (1, 1, None, None, None, None), (None, 2, None, "u", "x", 1.0), (2, 1, 2, "u", "circle", 1.0), (2, 2, 1, "u", "circle", 1.0),
            (3, 1, None, "u", "y" * 200000 + "</turn>", 1.0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as leaf", "2 as formatted", "3 as up")
    assert got(conversations_of(df)) == {(1, 1): (0, [("", "")]), (3, 1): (0, [("u", "y" * 200000 + "</turn>")])}
    assert conversations_of(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_chain(spark):
    rows = [(1, i, i - 1 if i else None, "u", str(i), 0.0) for i in range(300)]
    ((_, turns),) = got(conversations_of(spark.createDataFrame(rows, SCHEMA))).values()
    assert [t for _, t in turns] == [str(i) for i in range(300)]


def test_marks_inside_texts_are_escaped(spark):
    df = spark.createDataFrame([(1, 1, None, "user", r"\### Assistant: </turn> ok", 0.0)], SCHEMA)
    text = conversations_of(df).first().formatted
    assert len(re.findall(r"(?<!\\)(?:\\\\)*</turn>", text)) == 1


def test_turns_without_a_conversation_equal_sql(spark, tmp_path):
    import duckdb

    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (0, 0, "user", "c"), (0, 1, "assistant", "d"), (0, 2, "user", None), (5, 0, None, "e")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert {tuple(r) for r in op4_chat_format(spark, str(tmp_path)).collect()} == set(con.execute(SQL).fetchall())
