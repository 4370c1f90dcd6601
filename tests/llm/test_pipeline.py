import corpus_pipeline as P
from subventa.llm import registry
from subventa.llm.store import materialise
from tests.compare import duck
from tests.llm.test_minhash import brute as near_groups
from tests.llm.test_packing import check as check_pieces
from tests.llm.test_secrets import base

SF = "/root/testdata/sf0.001"


def sql(rows, name):
    """The SQL of a query over other documents."""
    con = duck(SF)
    con.execute("DROP VIEW documents")
    con.execute("CREATE TABLE documents AS SELECT * FROM rows")
    return con.execute(registry.ORACLES[name]).df()


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = docs.toPandas()
    left = {}
    for name, stage in P.STAGES:
        left[name] = materialise(stage(spark, docs, SF), "test-stage")
        docs = left[name]
    frames = {k: v.toPandas() for k, v in left.items()}
    assert all(list(left[k].columns) == columns for k in list(left)[:-1])

    verdict = sql(rows, "op9_quality_rules")
    assert sorted(frames["quality_rules"].doc_id) == sorted(verdict[verdict.kept].doc_id)

    cut = sql(frames["quality_rules"], "op1_line_dedup")
    assert sorted(zip(frames["line_dedup"].doc_id, frames["line_dedup"].text)) == sorted(zip(cut.doc_id, cut.text))
    assert (frames["line_dedup"].n_chars == frames["line_dedup"].text.str.len()).all()

    groups = near_groups(list(zip(frames["line_dedup"].doc_id, frames["line_dedup"].text)), 80, 5)
    assert sorted(frames["near_dedup"].doc_id) == sorted(doc for doc, _, _, kept in groups if kept)

    scanned = dict(zip(frames["secret_scan"].doc_id, frames["secret_scan"].text))
    for doc, text in zip(frames["near_dedup"].doc_id, frames["near_dedup"].text):
        assert not base(scanned[doc])
        if not base(text):
            assert scanned[doc] == text or "[SECRET]" in scanned[doc]

    check_pieces(left["packing"], list(scanned.items()), padding=0.01)


def test_run_and_empty_table(spark, tmp_path):
    assert P.run(spark, SF).count() > 0
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
