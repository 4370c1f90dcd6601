import math

import pytest
from pyspark.sql import functions as F

from subventa.operators import evaluate as V
from subventa.sources.tables import read_eval_rows, read_gold_set, write_eval_rows


def metrics(spark, ranked, ideal=("a", "b"), relevant=("c", "d"), **k):
    gold = spark.createDataFrame([("q", list(ideal), list(relevant))], "qid string, ideal array<string>, relevant array<string>")
    rows = spark.createDataFrame([("x", "q", d, i) for i, d in enumerate(ranked)], "config string, qid string, doc string, rank int")
    asked = spark.createDataFrame([("x", "q")], "config string, qid string")
    return V.query_metrics(rows, V.graded_gains(gold), asked, **k).first()


def test_metric_values(spark):
    assert metrics(spark, ["a", "c", "x", "y", "b"])["precision_5"] == pytest.approx(0.6)
    assert metrics(spark, ["x", "y", "z"], precision_k=3)["precision_5"] == 0
    assert metrics(spark, ["a", "c", "x"], recall_k=3)["recall_10"] == 0.5
    full = metrics(spark, ["a", "b", "c", "d"], ndcg_k=4)
    assert full["recall_10"] == 1 and full["ndcg_10"] == pytest.approx(1)
    turned = metrics(spark, ["d", "c", "b", "a"], ndcg_k=4)["ndcg_10"]
    assert 0 < turned < 1
    dcg = 2 / math.log2(2) + 1 / math.log2(3)
    idcg = 2 / math.log2(2) + 2 / math.log2(3) + 1 / math.log2(4)
    assert metrics(spark, ["a", "c", "x"], ndcg_k=3)["ndcg_10"] == pytest.approx(dcg / idcg)
    m = metrics(spark, ["x", "c", "a"])
    assert (m["mrr_lenient"], m["mrr_strict"]) == (0.5, pytest.approx(1 / 3))
    none = metrics(spark, ["x"], ideal=(), relevant=())
    assert all(none[c] == 0 for c in ("precision_5", "recall_10", "ndcg_10", "mrr_lenient", "mrr_strict"))
    assert metrics(spark, ["a"], precision_k=0)["precision_5"] == 0
    both = metrics(spark, ["a"], ideal=("a",), relevant=("a",))
    assert both["mrr_strict"] == 1 and both["recall_10"] == 1


def test_gold_set_and_rows(spark, tmp_path):
    path = tmp_path / "gold.jsonl"
    path.write_text('{"qid":"q1","lang":"de","query":"x","ideal":["a"],"relevant":["b"],"rationale":"r"}\n\n{"qid":"q2","lang":"en","query":"y","ideal":[]}\n')
    rows = {r["qid"]: r for r in read_gold_set(spark, str(path)).collect()}
    assert len(rows) == 2 and rows["q2"]["relevant"] == [] and rows["q2"]["rationale"] == ""
    out = spark.createDataFrame([("q1", "dense", "dense", False, 5, ["a"], 0.2, 1.0, 1.0, 1.0, 1.0)], read_eval_rows(spark, str(path)).schema)
    write_eval_rows(out, str(tmp_path / "rows"))
    assert read_eval_rows(spark, str(tmp_path / "rows")).collect() == out.collect()


def test_report_and_winners(spark):
    rows = spark.createDataFrame(
        [("dense", "q1", 0.5, 10), ("hybrid", "q1", 0.5, 20), ("dense", "q2", 0.1, 30), ("hybrid", "q2", 0.9, 40)],
        "config string, qid string, ndcg_10 double, elapsed_ms long",
    )
    for m in ("precision_5", "recall_10", "mrr_lenient", "mrr_strict"):
        rows = rows.withColumn(m, F.lit(0.0))
    report = V.aggregate_configs(rows).collect()
    assert [(r["config"], r["p50_ms"]) for r in report] == [("hybrid", 30.0), ("dense", 20.0)]
    queries = spark.createDataFrame([("q1", "short"), ("q2", "x" * 61)], "qid string, query string")
    won = {r["qid"]: r for r in V.query_winners(rows, queries).collect()}
    assert won["q1"]["winner"] == "dense" and won["q2"]["winner"] == "hybrid" and won["q2"]["query"] == "x" * 57 + "..."
