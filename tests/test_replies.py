import json

from pyspark.sql import functions as F

from subventa.operators import enrich as N
from subventa.operators import grounding as G
from subventa.operators import prompts as P
from subventa.operators import telemetry as T
from subventa.schema import CORPUS, ELIGIBILITY


def test_parse_and_grounding(spark):
    rows = [
        (1, '```json\n{"overall_pass": false, "summary": "s", "findings": [{"type":"other","severity":"Critical","grant_id":"g1","message":"m"},'
            '{"type":"other","severity":"x","grant_id":null,"message":"general"},{"type":"other","severity":"x","grant_id":"gX","message":"invented"}]}\n```'),
        (2, "no json"),
    ]
    parsed = G.parse_stage_replies(spark.createDataFrame(rows, "request_id int, reply string"), "critic")
    assert {r["request_id"]: r["failed"] for r in parsed.collect()} == {1: False, 2: True}
    findings = parsed.select("request_id", F.explode("parsed.findings").alias("f")).select("request_id", "f.*")
    cands = spark.createDataFrame([(1, "g1"), (2, "gX")], "request_id int, grant_id string")
    kept = G.normalised_findings(G.grounded_findings(findings, cands)).collect()
    assert {(r["message"], r["severity"]) for r in kept} == {("m", "high"), ("general", "low")}
    named = findings.filter("grant_id is not null")
    assert G.dropped_counts(named, cands).first().asDict() == {"request_id": 1, "total": 2, "dropped": 1}
    retry = spark.createDataFrame([(False, 1), (False, 2), (True, 1), (None, 1)], "p boolean, n int")
    assert [r["r"] for r in retry.select(G.should_retry(F.col("p"), F.col("n")).alias("r")).collect()] == [True, False, False, False]


def test_stage_limits(spark):
    def failed(stage, *records):
        rows = [(i, json.dumps(r)) for i, r in enumerate(records)]
        got = G.parse_stage_replies(spark.createDataFrame(rows, "i int, reply string"), stage)
        return [r["failed"] for r in got.orderBy("i").collect()]

    assert failed("planner", {"rewritten_query": "q"}, {"rewritten_query": ""}, {"rewritten_query": "q", "facts": {"sector": "x"}}, {}) == [False, True, True, True]
    assert failed("scorer", {}, {"scores": [{"grant_id": "g", "strengths": ["a"] * 6}]}, {"scores": [{"fit_label": "high"}]}) == [False, True, True]
    finding = {"type": "other", "severity": "?", "message": "m"}
    assert failed("critic", {"overall_pass": True}, {"findings": []}, {"overall_pass": False, "findings": [finding] * 11}, {"overall_pass": False, "findings": [finding | {"type": "x"}]}) == [False, True, True, True]
    rec = {"grant_id": "g", "grant_title": "t", "portal": "kfw", "source_url": "u", "fit": "high", "rationale": "r"}
    assert failed("writer", {"summary": "s", "recommendations": [rec]}, {"summary": "s", "recommendations": [rec | {"fit": "High"}]}, {"summary": "s" * 601}) == [False, True, True]


def test_enrichment(spark):
    good = {"sector": "deeptech", "secondary_sectors": ["hardware"], "federal_state": "Bayern", "target_groups": ["a", "b"],
            "eligibility_criteria": ["c"], "funding_phases": ["seed"], "funding_form": "stipend", "application_notes": "n"}
    replies = [
        ("g1", json.dumps(good)), ("g2", "{}"), ("g3", json.dumps(good | {"target_groups": ["x"] * 7})),
        ("g4", json.dumps(good | {"sector": "nope"})), ("g5", "[]"), ("g6", json.dumps(good | {"application_notes": "x" * 601})),
    ]
    checked = N.parse_enrichments(spark.createDataFrame(replies, "grant_id string, reply string"))
    ok = {r["grant_id"]: not r["reasons"] for r in checked.collect()}
    assert ok == {"g1": True, "g2": True, "g3": False, "g4": False, "g5": False, "g6": False}
    base = spark.createDataFrame([(f"g{i}", "saas" if i == 1 else None) for i in range(1, 8)], "grant_id string, sector string")
    for f in CORPUS.fields:
        if f.name not in base.columns:
            base = base.withColumn(f.name, F.lit(None).cast(f.dataType))
    done = F.when(F.col("grant_id") == "g7", F.from_json(F.lit('{"enrichment_version": 1}'), ELIGIBILITY))
    base = base.withColumn("eligibility", done)
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    merged = {r["grant_id"]: r for r in N.merge_enrichments(base, checked, now).collect()}
    assert merged["g1"]["sector"] == "saas" and merged["g1"]["federal_state"] == "Bayern"
    assert merged["g1"]["eligibility"]["criteria"] == ["c"] and merged["g1"]["eligibility"]["enrichment_version"] == 1
    assert merged["g2"]["eligibility"]["funding_form"] == "other" and merged["g2"]["sector"] is None
    assert merged["g3"]["eligibility"] is None
    work = N.work_list(base)
    assert {r["grant_id"] for r in work.filter("due").collect()} == {f"g{i}" for i in range(1, 7)}
    assert N.work_list(base, force=True).filter("due").count() == 7
    # the limit counts rows before the version test
    assert N.work_list(base.filter("grant_id >= 'g6'"), limit=2).filter("due").count() == 1
    tally = {r["status"]: r["n"] for r in N.enrichment_tally(N.enrichment_outcomes(work, checked)).collect()}
    assert tally == {"enriched": 2, "failed": 4, "skipped": 1}
    again = N.work_list(N.merge_enrichments(base, checked, now))
    assert {r["grant_id"] for r in again.filter("due").collect()} == {"g3", "g4", "g5", "g6"}


def test_prompts(spark):
    cands = spark.createDataFrame(
        [(1, 1, "g2", 'Say "hi"', None, 5.0), (1, 0, "g1", "A", "saas", None)],
        "request_id int, rank int, grant_id string, title string, sector string, funding_max_eur double",
    ).withColumn("eligibility", F.when(F.col("grant_id") == "g1", F.from_json(F.lit('{"criteria":["c"],"enrichment_version":1}'), ELIGIBILITY)))
    shown = json.loads(P.candidates_json(cands, "scorer").first()["candidates_json"])
    assert shown == [
        {"rank": 1, "grant_id": "g1", "title": "A", "funding_max_eur": None, "sector": "saas", "eligibility": {"criteria": ["c"]}},
        {"rank": 2, "grant_id": "g2", "title": 'Say "hi"', "funding_max_eur": 5.0},
    ]
    critic = json.loads(P.candidates_json(cands, "critic").first()["candidates_json"])
    assert critic == [{"rank": 1, "grant_id": "g1", "title": "A"}, {"rank": 2, "grant_id": "g2", "title": 'Say "hi"'}]
    findings = spark.createDataFrame(
        [(1, 1, "low", "other", None, "general"), (1, 0, "high", "fit_alignment", "g1", "wrong")],
        "request_id int, position int, severity string, type string, grant_id string, message string",
    )
    requests = spark.createDataFrame([(1, "find {{x}}"), (2, "none")], "request_id int, query string").withColumn(
        "profile", F.when(F.col("request_id") == 1, F.struct(F.lit("seed").alias("stage"), F.lit("").alias("team")))
    )
    prompts = P.prompt_context(requests, cands, "writer", "{{retry_block}}Q: {{query}} C: {{candidates_json}}", findings=findings)
    got = {r["request_id"]: r["prompt"] for r in prompts.collect()}
    assert got[2] == "Q: none C: []"
    assert got[1].startswith("You are RETRYING.") and "  - [high] fit_alignment (grant_id=g1): wrong\n  - [low] other: general\n\nQ: find {{x}}" in got[1]
    planner = P.prompt_context(requests, cands, "planner", "{{profile_block}}{{query}}", ["stage", "team"])
    plan = {r["request_id"]: r["prompt"] for r in planner.collect()}
    assert plan[2] == "none" and plan[1].endswith("question contradicts them):\n  - stage: seed\n\nfind {{x}}")


def test_trace(spark):
    rows = [
        (1, "planner", 5, None, None, None, 1), (1, "retrieval", 7, None, 8, None, 2), (1, "writer", 10, 1, None, None, 3),
        (1, "critic", 3, 1, None, False, 4), (1, "writer", 20, 2, None, None, 5), (1, "critic", 4, 2, None, True, 6), (2, "planner", 1, None, None, None, 1),
    ]
    df = spark.createDataFrame(rows, "request_id int, stage string, elapsed_ms long, attempt int, candidate_count int, overall_pass boolean, seq int")
    got = {r["request_id"]: r for r in T.stage_trace(df, ["seq"]).collect()}
    one = got[1]
    assert (one["writer_ms"], one["critic_ms"], one["total_ms"], one["writer_attempts"], one["critic_pass"]) == (30, 7, 49, 2, True)
    assert got[2]["critic_pass"] and got[2]["writer_attempts"] == 1 and got[2]["candidate_count"] == 0
