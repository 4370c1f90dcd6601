from pyspark.sql import functions as F

from subventa.operators import retrieve as R
from subventa.operators.query_block import held
from subventa.plans.corpora import documents_corpus, search_queries

SF = "/root/testdata/sf0.001"


def jobs(spark):
    return max([int(j) for j in spark.sparkContext._jsc.sc().statusTracker().getJobIdsForGroup(None)] or [-1]) + 1


def test_a_block_holds_the_queries_as_they_are(spark):
    rows = [(1, "Small loan", [0.5, 1.0], "p1", "de"), (2, None, None, None, None), (3, " ", [1.0, 0.0], None, "EU")]
    df = spark.createDataFrame(rows, "qid long, query string, embedding array<float>, portal string, country string")
    block = held(df)
    assert sorted(block.frame.collect()) == sorted(df.collect()) and block.frame.schema == df.schema
    assert block.vectors()["qid"].tolist() == [1, 3] and block.vectors()["country"].tolist() == ["DE", "EU"]
    grams = block.grams()
    assert set(grams["qid"]) == {1} and set(grams["q_size"]) == {len(grams)} and "  s" in set(grams["gram"])
    assert held(df, limit=2) is None and len(held(df.limit(0))) == 0


def test_building_a_search_runs_few_jobs(spark):
    queries, corpus = search_queries(spark, SF), documents_corpus(spark, SF)
    before = jobs(spark)
    found = R.retrieve(queries, corpus, R.HYBRID_RERANK, 10, R.contains_scorer)
    assert jobs(spark) - before <= 3
    large = R.retrieve(queries, corpus, R.HYBRID, 10).hits
    assert found.hits.count() > 0 and large.count() > 0


def test_empty_batches(spark):
    queries, corpus = search_queries(spark, SF).limit(0), documents_corpus(spark, SF)
    for mode in (R.DENSE, R.HYBRID, R.HYBRID_RERANK):
        assert R.retrieve(queries, corpus, mode, 10, R.contains_scorer).hits.count() == 0
    assert R.retrieve(queries.withColumn("country", F.lit("de")), corpus, R.HYBRID).hits.count() == 0
