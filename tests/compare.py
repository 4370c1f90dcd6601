"""Runs registered queries next to their SQL twins: python -m tests.compare <sf_dir> [name ...]."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def kind(v):
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, (int,)):
        return "int"
    if isinstance(v, (float, decimal.Decimal)):
        return "float"
    return type(v).__name__


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir: str, name: str, job, sql: str | None) -> tuple[bool, str]:
    t0 = time.time()
    df = job(spark, sf_dir)
    cols = sorted(df.columns)
    rows = [tuple(r[c] for c in cols) for r in df.collect()]
    spent = time.time() - t0
    if sql is None:
        return True, f"{name}: {len(rows)} rows, no SQL, {spent:.1f}s"
    t1 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    fetched = cur.fetchall()
    duck_spent = time.time() - t1
    if sorted(names) != cols:
        return False, f"{name}: columns {cols} vs {sorted(names)}"
    at = [names.index(c) for c in cols]
    other = [tuple(r[i] for i in at) for r in fetched]
    a = sorted([tuple(normal(v) for v in r) for r in rows], key=repr)
    b = sorted([tuple(normal(v) for v in r) for r in other], key=repr)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return False, f"{name}: rows {len(a)} vs {len(b)}; first differences {str(diff)[:700]}"
    for c, x, y in zip(cols, zip(*rows) if rows else [], zip(*other) if other else []):
        kinds = {kind(v) for v in x if v is not None} ^ {kind(v) for v in y if v is not None}
        if kinds:
            return False, f"{name}: column {c} types differ: {kinds}"
    return True, f"{name}: {len(a)} rows equal, spark {spent:.1f}s, sql {duck_spent:.1f}s"


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from subventa.session import build_session

    sf_dir, names = argv[0], argv[1:]
    spark = build_session(
        master="local[8]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    sqls = entry.oracle_sql()
    for name, job in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            ok, text = compare(spark, con, sf_dir, name, job, sqls.get(name))
        except Exception as error:
            ok, text = False, f"{name}: {type(error).__name__}: {str(error)[:1500]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + text, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
