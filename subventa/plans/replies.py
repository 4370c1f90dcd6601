"""Model-reply clean-up over customers as requests and their orders as candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from subventa.functions import labels as L
from subventa.functions.text import strip_fences
from subventa.operators import grounding as G
from subventa.operators import prompts as P
from subventa.operators import telemetry as T
from subventa.operators.bounds import spread_small
from subventa.operators.order import top_per_key
from subventa.plans.registry import query, table

# --- labels ----------------------------------------------------------------------

# Raw labels as a model might write them, one per event.
_RAW_SQL = """CASE event_type WHEN 'signup' THEN ' High fit ' WHEN 'click' THEN 'Medium' WHEN 'view' THEN 'MODERATE'
  WHEN 'error' THEN 'Blocker' WHEN 'purchase' THEN CASE WHEN value > 50 THEN 'm' END END"""


def _raw_label():
    kind = F.col("event_type")
    return (
        F.when(kind == "signup", " High fit ").when(kind == "click", "Medium").when(kind == "view", "MODERATE")
        .when(kind == "error", "Blocker").when((kind == "purchase") & (F.col("value") > 50), "m")
    )


@query(
    "label_fit",
    f"""SELECT event_id, CASE WHEN trim(lower(raw)) LIKE 'high%' OR trim(lower(raw)) = 'h' THEN 'high'
      WHEN trim(lower(raw)) LIKE 'med%' OR trim(lower(raw)) = 'm' THEN 'medium' ELSE 'low' END AS fit FROM (SELECT event_id, {_RAW_SQL} AS raw FROM events)""",
)
def label_fit(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", L.fit_label(_raw_label()).alias("fit"))


@query(
    "label_severity",
    f"""SELECT event_id, CASE WHEN trim(lower(raw)) LIKE 'high%' OR trim(lower(raw)) IN ('critical', 'blocker') THEN 'high'
      WHEN trim(lower(raw)) LIKE 'med%' OR trim(lower(raw)) LIKE 'mod%' THEN 'medium' ELSE 'low' END AS severity
    FROM (SELECT event_id, {_RAW_SQL} AS raw FROM events)""",
)
def label_severity(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", L.severity(_raw_label()).alias("severity"))


@query(
    "label_score",
    """SELECT event_id, CAST(CASE WHEN v IS NULL THEN 0 ELSE least(100, greatest(0, round_even(v, 0))) END AS INTEGER) AS score
    FROM (SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN floor(value) + 0.5 WHEN 'view' THEN -value ELSE value END AS v FROM events)""",
)
def label_score(spark, sf_dir):
    kind, v = F.col("event_type"), F.col("value")
    raw = (
        F.when(kind == "error", "n/a")
        .when(kind == "click", (F.floor(v) + 0.5).cast("string"))
        .when(kind == "view", (-v).cast("string"))
        .otherwise(v.cast("string"))
    )
    return table(spark, sf_dir, "events").select("event_id", L.clamp_score(raw).alias("score"))


# --- grounding ---------------------------------------------------------------------

# A request's candidates are the customer's orders by price; a reply cites every
# order key of its line items' parts, so some citations are wrong.
_CANDIDATES_SQL = """
cand AS (SELECT o_custkey AS request_id, o_orderkey AS grant_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS INTEGER) AS rank,
  'Order ' || o_orderkey AS title, o_orderpriority AS portal FROM orders),
cited AS (SELECT o.o_custkey AS request_id, CASE WHEN l.l_returnflag = 'R' THEN NULL WHEN l.l_linestatus = 'F' THEN l.l_partkey ELSE l.l_orderkey END AS grant_id,
  l.l_linenumber AS line, l.l_quantity AS quantity, l.l_partkey AS part FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey)
"""


def candidates(spark, sf_dir, k=None):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("request_id"),
        F.col("o_orderkey").alias("grant_id"),
        "o_totalprice",
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.col("o_orderpriority").alias("portal"),
    )
    if k is None:
        return rows
    return top_per_key(rows, ["request_id"], [F.desc("o_totalprice"), F.col("grant_id")], k)


def _cited(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    grant = F.when(F.col("l_returnflag") == "R", None).when(F.col("l_linestatus") == "F", F.col("l_partkey")).otherwise(F.col("l_orderkey"))
    return li.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("request_id"),
        grant.alias("grant_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_partkey").alias("part"),
    )


@query(
    "grounded_scores",
    f"WITH {_CANDIDATES_SQL} SELECT * FROM cited WHERE EXISTS (SELECT 1 FROM cand WHERE cand.request_id = cited.request_id AND cand.grant_id = cited.grant_id)",
)
def grounded_scores(spark, sf_dir):
    return G.grounded(_cited(spark, sf_dir), candidates(spark, sf_dir))


@query(
    "ungrounded_scores",
    f"""WITH {_CANDIDATES_SQL} SELECT * FROM cited WHERE grant_id IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM cand WHERE cand.request_id = cited.request_id AND cand.grant_id = cited.grant_id)""",
)
def ungrounded_scores(spark, sf_dir):
    return G.ungrounded(_cited(spark, sf_dir).filter(F.col("grant_id").isNotNull()), candidates(spark, sf_dir))


@query(
    "grounded_findings",
    f"""WITH {_CANDIDATES_SQL} SELECT * FROM cited WHERE grant_id IS NULL
      OR EXISTS (SELECT 1 FROM cand WHERE cand.request_id = cited.request_id AND cand.grant_id = cited.grant_id)""",
)
def grounded_findings(spark, sf_dir):
    return G.grounded_findings(_cited(spark, sf_dir), candidates(spark, sf_dir))


@query(
    "grounding_drops",
    f"""WITH {_CANDIDATES_SQL} SELECT request_id, count(*) AS total, count(*) FILTER (NOT EXISTS (SELECT 1 FROM cand
      WHERE cand.request_id = x.request_id AND cand.grant_id = x.grant_id)) AS dropped FROM (SELECT * FROM cited WHERE grant_id IS NOT NULL) x GROUP BY request_id""",
)
def grounding_drops(spark, sf_dir):
    return G.dropped_counts(_cited(spark, sf_dir).filter(F.col("grant_id").isNotNull()), candidates(spark, sf_dir))


@query(
    "retry_routing",
    """SELECT event_id, coalesce(NOT CASE event_type WHEN 'error' THEN FALSE WHEN 'view' THEN FALSE WHEN 'click' THEN NULL ELSE TRUE END, FALSE)
      AND CAST(floor(value / 100) AS INTEGER) < 2 AS retry FROM events""",
)
def retry_routing(spark, sf_dir):
    kind = F.col("event_type")
    passed = F.when(kind.isin("error", "view"), False).when(kind == "click", None).otherwise(True)
    return table(spark, sf_dir, "events").select(
        "event_id", G.should_retry(passed, F.floor(F.col("value") / 100).cast("int")).alias("retry")
    )


_ERROR_SQL = "'timeout for ' || c_name || repeat('!', 100)"


def _requests(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("request_id"),
        F.concat(F.lit("timeout for "), "c_name", F.repeat(F.lit("!"), 100)).alias("error"),
        (F.col("c_acctbal") > 5000).alias("answered"),
    )


@query(
    "writer_fallback",
    f"""WITH {_CANDIDATES_SQL} SELECT cand.request_id, cand.grant_id, cand.rank, cand.title AS grant_title, cand.portal, 'medium' AS fit,
      'Writer model unavailable (' || left({_ERROR_SQL}, 120) || '). Returning the top retrieval matches without LLM-curated rationale.' AS summary
    FROM cand JOIN customer c ON c.c_custkey = cand.request_id WHERE c.c_acctbal <= 5000 AND cand.rank < 3""",
)
def writer_fallback(spark, sf_dir):
    requests = _requests(spark, sf_dir)
    rows = G.fallback_recommendations(requests, requests.filter("answered"), candidates(spark, sf_dir, 8))
    return rows.select("request_id", "grant_id", "rank", "grant_title", "portal", "fit", "summary")


@query(
    "writer_empty_answers",
    f"""SELECT c_custkey AS request_id, '{G.EMPTY_SUMMARY}' AS summary, CAST(0 AS BIGINT) AS recommendations FROM customer
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""",
)
def writer_empty(spark, sf_dir):
    closed = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F")
    return G.empty_answers(_requests(spark, sf_dir), closed.select(F.col("o_custkey").alias("request_id")))


# --- replies ------------------------------------------------------------------------

@query(
    "reply_types",
    """SELECT o_orderkey, o_orderkey % 8 NOT IN (4, 5, 6) AS failed,
      CAST(CASE o_orderkey % 8 WHEN 4 THEN 0 WHEN 5 THEN 0 WHEN 6 THEN 71 END AS INTEGER) AS score FROM orders""",
)
def reply_types(spark, sf_dir):
    """Scorer replies with wrong kinds or missing fields; a score that is no decimal number counts 0."""
    texts = [
        '{"scores": "none"}',
        '{"scores": [1, 2]}',
        '{"scores": [{"grant_id": "g", "fit_label": "high"}]}',
        '{"scores": [{"grant_id": "g", "eligibility_score": 5}]}',
        '{"scores": [{"grant_id": "g", "eligibility_score": "12d", "fit_label": null}]}',
        '{"scores": [{"grant_id": "g", "eligibility_score": "0x1p3", "fit_label": "high"}]}',
        '{"scores": [{"grant_id": "g", "eligibility_score": " 70.6 ", "fit_label": "m", "strengths": ["a"]}]}',
        '{"scores": [{"grant_id": "g", "eligibility_score": 5, "fit_label": "m", "strengths": "a"}]}',
    ]
    reply = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    parsed = G.parse_stage_replies(table(spark, sf_dir, "orders").select("o_orderkey", reply.alias("reply")), "scorer")
    scores = parsed.select("o_orderkey", "failed", F.explode_outer("parsed.scores").alias("s"))
    return scores.select("o_orderkey", "failed", L.clamp_score(F.col("s.eligibility_score")).alias("_raw"), "s").select(
        "o_orderkey", "failed", F.when(F.col("s").isNotNull(), F.col("_raw")).alias("score")
    )


# One scorer reply per order; fenced, plain, a bare array, or cut short.
@query(
    "reply_parse",
    """SELECT o_orderkey, o_orderstatus = 'P' OR o_orderpriority = '5-LOW' AS failed,
      CASE WHEN NOT (o_orderstatus = 'P' OR o_orderpriority = '5-LOW') THEN 'g' || o_custkey END AS grant_id,
      CASE WHEN NOT (o_orderstatus = 'P' OR o_orderpriority = '5-LOW') THEN CAST(least(100, round_even(o_totalprice / 5000, 0)) AS INTEGER) END AS score,
      CASE WHEN NOT (o_orderstatus = 'P' OR o_orderpriority = '5-LOW') THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'medium' ELSE 'low' END END AS fit
    FROM orders""",
)
def reply_parse(spark, sf_dir):
    p, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    label = F.when(p == "1-URGENT", " HIGH").when(p == "2-HIGH", "Med").otherwise("unsure")
    score = F.struct(
        F.concat(F.lit("g"), F.col("o_custkey").cast("string")).alias("grant_id"),
        (F.col("o_totalprice") / 5000).alias("eligibility_score"),
        label.alias("fit_label"),
    )
    record = F.to_json(F.struct(F.array(score).alias("scores")))
    reply = (
        F.when(status == "P", F.concat(F.lit("["), record, F.lit("]")))
        .when(p == "5-LOW", F.left(record, F.length(record) - 3))
        .when(p == "1-URGENT", F.concat(F.lit("```json\n"), record, F.lit("\n```")))
        .when(p == "2-HIGH", F.concat(F.lit("```"), record, F.lit("```")))
        .otherwise(record)
    )
    rows = spread_small(table(spark, sf_dir, "orders")).select("o_orderkey", reply.alias("reply"))
    parsed = G.parse_stage_replies(rows, "scorer").select(
        "o_orderkey", "failed", F.explode_outer("parsed.scores").alias("s")
    )
    flat = parsed.select("o_orderkey", "failed", "s.grant_id", "s.eligibility_score", "s.fit_label")
    shaped = G.normalised_scores(flat)
    return shaped.select(
        "o_orderkey",
        "failed",
        "grant_id",
        F.when(~F.col("failed"), F.col("eligibility_score")).alias("score"),
        F.when(~F.col("failed"), F.col("fit_label")).alias("fit"),
    )


@query(
    "reply_fences",
    """SELECT conv_id, turn, trim(text, ' ' || chr(10)) AS bare FROM conversations""",
)
def reply_fences(spark, sf_dir):
    role, text = F.col("role"), F.col("text")
    reply = (
        F.when(role == "user", F.concat(F.lit("  ```json\n"), text, F.lit("\n```\n")))
        .when(role == "assistant", F.concat(F.lit("```\n"), text, F.lit("```")))
        .otherwise(text)
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", strip_fences(reply).alias("bare"))


# --- prompt contexts -------------------------------------------------------------------

_TEMPLATE = "{{retry_block}}Question: {{query}}\n{{profile_block}}Candidates: {{candidates_json}}"


@query(
    "prompt_context",
    f"""WITH {_CANDIDATES_SQL}, cj AS (SELECT request_id, '[' || string_agg('{{"rank":' || (rank + 1) || ',"grant_id":"' || grant_id || '","title":"' || title
        || '","portal":"' || portal || '"}}', ',' ORDER BY rank) || ']' AS j FROM cand WHERE rank < 8 GROUP BY request_id)
    SELECT c_custkey AS request_id, 'Question: ' || c_name || chr(10) || 'Saved startup profile (use to check profile_misuse):' || chr(10)
      || CASE WHEN c_acctbal > 0 THEN '  - segment: ' || c_mktsegment || chr(10) ELSE '' END || '  - nation: ' || c_nationkey || chr(10) || chr(10)
      || 'Candidates: ' || coalesce(j, '[]') AS prompt FROM customer LEFT JOIN cj ON cj.request_id = c_custkey""",
)
def prompt_context(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    profile = F.struct(
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise("").alias("segment"),
        F.lit(None).cast("string").alias("stage"),
        F.col("c_nationkey").alias("nation"),
    )
    requests = c.select(F.col("c_custkey").alias("request_id"), F.col("c_name").alias("query"), profile.alias("profile"))
    shown = candidates(spark, sf_dir, 8).withColumn("grant_id", F.col("grant_id").cast("string"))
    return P.prompt_context(
        requests, shown, "critic", _TEMPLATE, ["segment", "stage", "nation"], extra={"retry_block": F.lit("")}
    )


@query(
    "prompt_retry_block",
    """WITH f AS (SELECT o_orderkey // 8 AS request_id, o_orderkey, o_orderdate, o_orderpriority, o_orderstatus FROM orders)
    SELECT request_id, 'You are RETRYING. A previous attempt was reviewed by the Critic and' || chr(10)
      || 'the following issues were flagged. Address EACH one in your output:' || chr(10)
      || string_agg('  - [' || CASE WHEN o_orderpriority = '1-URGENT' THEN 'high' ELSE 'low' END || '] fit_alignment'
        || CASE WHEN o_orderstatus = 'F' THEN '' ELSE ' (grant_id=' || o_orderkey || ')' END || ': ' || o_orderpriority, chr(10) ORDER BY o_orderkey)
      || chr(10) || chr(10) AS retry_block FROM f GROUP BY request_id""",
)
def prompt_retry_block(spark, sf_dir):
    """Eight neighbouring orders are the findings of one request."""
    o = table(spark, sf_dir, "orders")
    findings = o.select(
        F.floor(F.col("o_orderkey") / 8).alias("request_id"),
        F.col("o_orderkey").alias("position"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "high").otherwise("low").alias("severity"),
        F.lit("fit_alignment").alias("type"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey").cast("string")).alias("grant_id"),
        F.col("o_orderpriority").alias("message"),
    )
    return P.retry_blocks(findings)


_NAMED = """'{"rank":' || (rank + 1) || ',"grant_id":"' || grant_id || '","title":"' || title || '","portal":"' || portal || '"'"""
_PLACED = """',"country":' || CASE WHEN grant_id % 2 = 0 THEN '"DE"' ELSE 'null' END"""
_SECTOR = """CASE WHEN grant_id % 3 = 0 THEN ',"sector":"health"' ELSE '' END || '}'"""


def _shown(spark, sf_dir):
    """The best eight orders of a customer as candidates, some without a country or a sector."""
    shown = candidates(spark, sf_dir, 8)
    number = F.col("grant_id")
    return shown.withColumns(
        {
            "country": F.when(number % 2 == 0, "DE"),
            "sector": F.when(number % 3 == 0, "health"),
            "source_url": F.concat(F.lit("https://example.org/"), number.cast("string")),
            "grant_id": number.cast("string"),
        }
    )


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_name").alias("query"))


@query(
    "prompt_planner",
    """SELECT c_custkey AS request_id, CASE WHEN c_acctbal > 0 OR c_custkey % 2 = 0 THEN 'Known startup profile (trust these unless the question contradicts them):' || chr(10)
      || concat_ws(chr(10), CASE WHEN c_acctbal > 0 THEN '  - segment: ' || c_mktsegment END, CASE WHEN c_custkey % 2 = 0 THEN '  - nation: ' || c_nationkey END) || chr(10) || chr(10)
      ELSE '' END || 'Question: ' || c_name AS prompt FROM customer""",
)
def prompt_planner(spark, sf_dir):
    """Questions with what is known of the startup; a block without a filled field is left out."""
    profile = F.struct(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("nation"))
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_name").alias("query"), profile.alias("profile"))
    return P.prompt_context(requests, requests.limit(0), "planner", "{{profile_block}}Question: {{query}}", ["segment", "nation"])


@query(
    "prompt_scorer",
    f"""WITH {_CANDIDATES_SQL}, cj AS (SELECT request_id, '[' || string_agg({_NAMED} || {_PLACED} || {_SECTOR}, ',' ORDER BY rank) || ']' AS j FROM cand WHERE rank < 8 GROUP BY request_id)
    SELECT c_custkey AS request_id, c_name || ' ' || coalesce(j, '[]') AS prompt FROM customer LEFT JOIN cj ON cj.request_id = c_custkey""",
)
def prompt_scorer(spark, sf_dir):
    return P.prompt_context(_asked(spark, sf_dir), _shown(spark, sf_dir), "scorer", "{{query}} {{candidates_json}}")


@query(
    "prompt_writer",
    f"""WITH {_CANDIDATES_SQL}, cj AS (SELECT request_id, '[' || string_agg({_NAMED} || ',"source_url":"https://example.org/' || grant_id || '"' || {_PLACED} || {_SECTOR}, ',' ORDER BY rank) || ']' AS j
      FROM cand WHERE rank < 8 GROUP BY request_id),
    f AS (SELECT o_custkey AS request_id, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders),
    rb AS (SELECT request_id, 'You are RETRYING. A previous attempt was reviewed by the Critic and' || chr(10)
      || 'the following issues were flagged. Address EACH one in your output:' || chr(10)
      || string_agg('  - [low] other (grant_id=' || o_orderkey || '): ' || o_orderpriority, chr(10) ORDER BY nth) || chr(10) || chr(10) AS block FROM f WHERE nth <= 10 GROUP BY request_id)
    SELECT c_custkey AS request_id, coalesce(block, '') || c_name || ' ' || coalesce(j, '[]') AS prompt FROM customer LEFT JOIN cj ON cj.request_id = c_custkey LEFT JOIN rb ON rb.request_id = c_custkey""",
)
def prompt_writer(spark, sf_dir):
    """A second attempt: all orders of a customer are findings, of which ten are shown."""
    findings = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("request_id"), F.col("o_orderkey").alias("position"), F.lit("low").alias("severity"), F.lit("other").alias("type"),
        F.col("o_orderkey").cast("string").alias("grant_id"), F.col("o_orderpriority").alias("message"),
    )
    return P.prompt_context(_asked(spark, sf_dir), _shown(spark, sf_dir), "writer", "{{retry_block}}{{query}} {{candidates_json}}", findings=findings)


@query(
    "prompt_enrichment",
    r"""WITH t AS (SELECT doc_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents)
    SELECT doc_id AS grant_id, 'Document ' || doc_id || ' | ' || CASE WHEN doc_id % 3 > 0 THEN left(text, 40) ELSE '' END || ' | ' || left(body, 3500) || ' (3500)' AS prompt FROM t""",
)
def prompt_enrichment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    grants = docs.select(
        F.col("doc_id").alias("grant_id"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.when(F.col("doc_id") % 3 > 0, F.left("text", F.lit(40))).alias("summary"), F.concat(F.lit(" \n"), "text", F.lit("\t ")).alias("body"),
    )
    return P.enrichment_prompts(grants, "{{title}} | {{summary}} | {{body_excerpt}} ({{excerpt_chars}})")


# --- costs and traces ---------------------------------------------------------------------


@query(
    "token_costs",
    """WITH s AS (SELECT event_type AS model, CAST(ts AS DATE) AS day, CAST(sum(CAST(value * 100 AS BIGINT)) AS BIGINT) AS input_tokens,
      CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS output_tokens FROM events GROUP BY ALL)
    SELECT *, round(input_tokens * 0.075 / 1e6 + output_tokens * 0.30 / 1e6, 9) AS usd_cost FROM s""",
)
def token_costs(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("model"),
        "ts",
        F.round(F.col("value") * 100).cast("bigint").alias("input_tokens"),
        F.get_json_object("props", "$.k").cast("bigint").alias("output_tokens"),
    )
    return T.cost_rollup(calls).withColumn("usd_cost", F.round("usd_cost", 9))


# Events as stage timings, one request per user.
_STAGE_SQL = """CASE event_type WHEN 'signup' THEN 'planner' WHEN 'view' THEN 'retrieval' WHEN 'click' THEN 'scorer'
  WHEN 'purchase' THEN 'writer' ELSE 'critic' END"""


@query(
    "stage_trace",
    f"""WITH s AS (SELECT user_id AS request_id, {_STAGE_SQL} AS stage, CAST(floor(value) AS BIGINT) AS ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id, value FROM events)
    SELECT request_id, {', '.join(f"CAST(coalesce(sum(ms) FILTER (stage = '{s}'), 0) AS BIGINT) AS {s}_ms" for s in T.STAGES)},
      CAST(sum(ms) AS BIGINT) AS total_ms, coalesce(max(k) FILTER (stage = 'retrieval'), 0) AS candidate_count,
      coalesce(arg_max(value < 100, event_id) FILTER (stage = 'critic'), TRUE) AS critic_pass,
      greatest(coalesce(max(k) FILTER (stage = 'writer'), 1), 1) AS writer_attempts FROM s GROUP BY request_id""",
)
def stage_trace(spark, sf_dir):
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("bigint")
    stage = (
        F.when(kind == "signup", "planner").when(kind == "view", "retrieval").when(kind == "click", "scorer")
        .when(kind == "purchase", "writer").otherwise("critic")
    )
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("request_id"),
        stage.alias("stage"),
        F.floor("value").alias("elapsed_ms"),
        k.alias("attempt"),
        k.alias("candidate_count"),
        (F.col("value") < 100).alias("overall_pass"),
        "event_id",
    )
    return T.stage_trace(rows, ["event_id"])
