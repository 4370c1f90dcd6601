"""Ingest and enrichment over documents, labels and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from subventa.functions import text as X
from subventa.operators import embed as M
from subventa.operators import enrich as N
from subventa.operators import ingest as I
from subventa.operators.extract import split_valid, with_rejections
from subventa.operators.workflow import arrivals_of, ingest_pages
from subventa.plans.extraction import HASH_SQL, RECORDS_SQL, portal_pages, records
from subventa.plans.registry import query, table
from subventa.schema import CORPUS, ELIGIBILITY
from subventa.sources.shared import shared_path
from subventa.sources.snapshots import corpus_table

_T0 = "2024-01-01 00:00:00"
_NOW = "2024-06-01 00:00:00"
# Repeated urls arrive in later waves, this many numbers apart.
_WAVE = 10_000_000

_VALID = """length(title) BETWEEN 1 AND 500 AND portal <> 'news' AND status <> 'paused' AND length(country) = 2
  AND funding_min_eur >= 0 AND funding_max_eur < 999999999999.995"""

# Labelled documents are stored already; those of low quality in an older wording,
# toxic ones with an enriched sector and eligibility.
_TARGET_SQL = f"""
SELECT 'g' || doc_id AS grant_id, source_url, portal, title, summary, CASE WHEN quality = 0 THEN 'Alt: ' || body ELSE body END AS body,
  country, status, federal_state, CASE WHEN toxic = 1 THEN 'other' ELSE sector END AS sector,
  CASE WHEN toxic = 1 THEN 'loan' END AS funding_form, funding_max_eur, has_vector,
  sha256(title || '|' || summary || '|' || CASE WHEN quality = 0 THEN 'Alt: ' || body ELSE body END || '|'
    || coalesce(sector, '') || '|' || country || '|' || coalesce(federal_state, '')) AS source_hash
FROM (SELECT r.*, l.quality, l.toxic, e.vec_id IS NOT NULL AS has_vector FROM ({RECORDS_SQL}) r JOIN labels l USING (doc_id)
  LEFT JOIN embeddings e ON e.vec_id = r.doc_id)
"""


def stored_corpus(spark, sf_dir):
    base = (
        records(spark, sf_dir)
        .join(table(spark, sf_dir, "labels"), "doc_id")
        .join(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id").drop("label"), "doc_id", "left")
    )
    old = base.withColumn("body", F.when(F.col("quality") == 0, F.concat(F.lit("Alt: "), "body")).otherwise(F.col("body")))
    enriched = F.col("toxic") == 1
    eligibility = F.when(
        enriched,
        F.named_struct(
            F.lit("target_groups"), F.array(F.lit("SMEs")), F.lit("criteria"), F.array().cast("array<string>"),
            F.lit("funding_phases"), F.array().cast("array<string>"), F.lit("funding_form"), F.lit("loan"),
            F.lit("secondary_sectors"), F.array().cast("array<string>"), F.lit("application_notes"), F.lit(""),
            F.lit("enrichment_version"), F.lit(1), F.lit("enriched_at"), F.lit(_T0).cast("timestamp"),
        ).cast(ELIGIBILITY),
    )
    stamp = F.lit(_T0).cast("timestamp")
    rows = I.with_hash(old).withColumns(
        {
            "grant_id": F.concat(F.lit("g"), F.col("doc_id").cast("string")),
            "sector": F.when(enriched, "other").otherwise(F.col("sector")),
            "eligibility": eligibility,
            "created_at": stamp,
            "updated_at": stamp,
        }
    )
    return rows.select(
        *[
            # An amount beyond the column's range cannot be stored.
            F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in CORPUS.fields
        ]
    )


_ARRIVALS_SQL = f"""
v AS (SELECT * FROM ({RECORDS_SQL}) WHERE {_VALID}),
w AS (SELECT v.*, doc_id AS arrival FROM v
  UNION ALL SELECT v.* REPLACE (body || ' (neu)' AS body), doc_id + {_WAVE} FROM v JOIN labels l USING (doc_id) WHERE l.toxic = 1
  UNION ALL SELECT v.* REPLACE (body || ' (neu)' AS body), doc_id + {2 * _WAVE} FROM v JOIN labels l USING (doc_id) WHERE l.toxic = 1),
arr AS (SELECT *, {HASH_SQL} AS source_hash FROM w),
tgt AS ({_TARGET_SQL}),
acted AS (SELECT source_url, arrival, portal, lang, source_hash, coalesce(prev, stored) AS before,
    CASE WHEN coalesce(prev, stored) IS NULL THEN 'inserted' WHEN coalesce(prev, stored) = source_hash THEN 'skipped_unchanged' ELSE 'updated' END AS action
  FROM (SELECT arr.*, lag(arr.source_hash) OVER (PARTITION BY arr.source_url ORDER BY arrival) AS prev, tgt.source_hash AS stored
    FROM arr LEFT JOIN tgt ON tgt.source_url = arr.source_url))
"""


def arrivals(spark, sf_dir):
    valid, _ = split_valid(records(spark, sf_dir).withColumn("parse_error", F.lit(None).cast("string")))
    first = valid.withColumn("arrival", F.col("doc_id"))
    toxic = table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select("doc_id")
    again = first.join(toxic, "doc_id", "left_semi").withColumn("body", F.concat("body", F.lit(" (neu)")))
    waves = first.unionByName(again.withColumn("arrival", F.col("doc_id") + _WAVE)).unionByName(
        again.withColumn("arrival", F.col("doc_id") + 2 * _WAVE)
    )
    return arrivals_of(waves)


@query("ingest_actions", f"WITH {_ARRIVALS_SQL} SELECT source_url, arrival, action FROM acted")
def ingest_actions(spark, sf_dir):
    acted = I.classify_arrivals(arrivals(spark, sf_dir), stored_corpus(spark, sf_dir))
    return acted.select("source_url", "arrival", "action")


_NEXT_SQL = f"""WITH {_ARRIVALS_SQL},
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY arrival DESC) AS rn FROM arr) WHERE rn = 1),
nxt AS (
  SELECT t.grant_id, t.source_url, CASE WHEN c.ch THEN l.title ELSE t.title END AS title, CASE WHEN c.ch THEN l.body ELSE t.body END AS body,
    CASE WHEN c.ch THEN coalesce(l.sector, t.sector) ELSE t.sector END AS sector, t.funding_form,
    CASE WHEN c.ch THEN l.source_hash ELSE t.source_hash END AS source_hash,
    CASE WHEN c.ch THEN FALSE ELSE t.has_vector END AS has_vector,
    CAST(CASE WHEN c.ch THEN l.funding_max_eur ELSE t.funding_max_eur END AS DOUBLE) AS funding_max_eur,
    TIMESTAMP '{_T0}' AS created_at, CASE WHEN c.ch THEN TIMESTAMP '{_NOW}' ELSE TIMESTAMP '{_T0}' END AS updated_at
  FROM tgt t LEFT JOIN last l USING (source_url),
    LATERAL (SELECT l.source_hash IS NOT NULL AND l.source_hash <> t.source_hash AS ch) c
  UNION ALL
  SELECT sha256(source_url), source_url, title, body, sector, NULL, source_hash, FALSE, CAST(funding_max_eur AS DOUBLE),
    TIMESTAMP '{_NOW}', TIMESTAMP '{_NOW}' FROM last WHERE source_url NOT IN (SELECT source_url FROM tgt))
"""


def _next(spark, sf_dir):
    return I.upsert_snapshot(stored_corpus(spark, sf_dir), arrivals(spark, sf_dir), F.lit(_NOW).cast("timestamp"))


@query("ingest_snapshot", f"{_NEXT_SQL} SELECT grant_id, source_url, title, body, source_hash FROM nxt")
def ingest_snapshot(spark, sf_dir):
    return _next(spark, sf_dir).select("grant_id", "source_url", "title", "body", "source_hash")


@query(
    "ingest_preserved_columns",
    f"{_NEXT_SQL} SELECT grant_id, sector, funding_form, has_vector, created_at, updated_at FROM nxt",
)
def ingest_preserved(spark, sf_dir):
    return _next(spark, sf_dir).select(
        "grant_id",
        "sector",
        F.col("eligibility.funding_form").alias("funding_form"),
        F.col("embedding").isNotNull().alias("has_vector"),
        "created_at",
        "updated_at",
    )


@query(
    "ingest_changes",
    f"""{_NEXT_SQL} SELECT nxt.source_url, nxt.source_hash, CASE WHEN tgt.source_url IS NULL THEN 'inserted' ELSE 'updated' END AS action
    FROM nxt LEFT JOIN tgt USING (source_url) WHERE tgt.source_hash IS DISTINCT FROM nxt.source_hash""",
)
def ingest_changes(spark, sf_dir):
    """The rows a batch writes."""
    rows = I.upsert_changes(stored_corpus(spark, sf_dir), arrivals(spark, sf_dir), F.lit(_NOW).cast("timestamp"))
    action = F.when(F.col("created_at") == F.col("updated_at"), I.INSERTED).otherwise(I.UPDATED)
    return rows.select("source_url", "source_hash", action.alias("action"))


@query("ingest_store", f"{_NEXT_SQL} SELECT grant_id, source_url, title, body, source_hash, created_at, updated_at FROM nxt")
def ingest_store(spark, sf_dir):
    """The next snapshot as a table of versions gives it: a base, a delta of the changed rows, merged while read."""
    store = corpus_table(spark, shared_path(spark, "corpus"))
    store.replace(stored_corpus(spark, sf_dir), 1)
    batch = arrivals(spark, sf_dir)
    store.append(I.upsert_changes(store.lookup(batch), batch, F.lit(_NOW).cast("timestamp")), 2)
    return store.read().select("grant_id", "source_url", "title", "body", "source_hash", "created_at", "updated_at")


@query("ingest_idempotent", f"{_NEXT_SQL} SELECT count(*) AS rows, 0 AS changed FROM nxt")
def ingest_idempotent(spark, sf_dir):
    """A second run of the same final content skips every url."""
    batch = arrivals(spark, sf_dir)
    after = _next(spark, sf_dir)
    final = I.last_arrivals(batch).withColumn("arrival", F.lit(0).cast("bigint"))
    changed = I.classify_arrivals(final, after).filter(F.col("action") != I.SKIPPED)
    rows = after.agg(F.count(F.lit(1)).alias("rows"))
    again = changed.agg(F.count(F.lit(1)).cast("int").alias("changed"))
    return rows.withColumn("_k", F.lit(1)).join(again.withColumn("_k", F.lit(1)), "_k").drop("_k")


_COUNTERS_SQL = f"""WITH {_ARRIVALS_SQL}, outcomes AS (SELECT 'run-' || lang AS run_id, portal, action FROM acted
  UNION ALL SELECT 'run-' || lang, portal, 'failed' FROM ({RECORDS_SQL}) WHERE NOT ({_VALID})),
counters AS (SELECT run_id, portal, count(*) FILTER (action = 'inserted') AS inserted, count(*) FILTER (action = 'updated') AS updated,
  count(*) FILTER (action = 'skipped_unchanged') AS skipped_unchanged, count(*) FILTER (action = 'failed') AS failed FROM outcomes GROUP BY ALL)"""


def _counters(spark, sf_dir):
    acted = I.classify_arrivals(arrivals(spark, sf_dir), stored_corpus(spark, sf_dir)).select("lang", "portal", "action")
    bad = with_rejections(records(spark, sf_dir)).filter(F.size("reasons") > 0)
    outcomes = acted.unionByName(bad.select("lang", "portal", F.lit(I.FAILED).alias("action")))
    return I.run_counters(outcomes.withColumn("run_id", F.concat(F.lit("run-"), "lang")))


@query("ingest_run_counters", f"{_COUNTERS_SQL} SELECT * FROM counters")
def ingest_counters(spark, sf_dir):
    return _counters(spark, sf_dir)


@query(
    "ingest_run_status",
    f"""{_COUNTERS_SQL} SELECT run_id, portal, CASE WHEN failed > 0 AND inserted + updated > 0 THEN 'partial' WHEN failed > 0 THEN 'failed'
      ELSE 'success' END AS status FROM counters""",
)
def ingest_status(spark, sf_dir):
    return I.with_run_status(_counters(spark, sf_dir)).select("run_id", "portal", "status")


@query(
    "ingest_page_run",
    """SELECT portal, count(*) FILTER (portal <> 'bmbf') AS inserted, count(*) FILTER (portal = 'bmbf') AS failed,
      CASE WHEN portal = 'bmbf' THEN 'failed' ELSE 'success' END AS status FROM (SELECT CASE WHEN url LIKE '%spam-farm%' THEN 'bmbf'
        WHEN url LIKE '%/de/%' AND url LIKE 'https:%' THEN 'kfw' WHEN url LIKE '%/de/%' THEN 'bayern'
        WHEN url LIKE '%/fr/%' THEN 'exist' WHEN url LIKE '%/es/%' THEN 'nrw' WHEN url LIKE '%example.com/en/%' THEN 'eic'
        WHEN url LIKE '%example.net/en/%' THEN 'horizon' WHEN url LIKE '%example.org/en/%' THEN 'bw' ELSE 'bmbf' END AS portal FROM pages) GROUP BY portal""",
)
def ingest_page_run(spark, sf_dir):
    """A first run over all pages, down to its ledger rows."""
    empty = spark.createDataFrame([], CORPUS)
    run = ingest_pages(portal_pages(spark, sf_dir), empty, F.lit("run-1"), F.lit(_NOW).cast("timestamp"))
    return run.ledger.select("portal", "inserted", "failed", "status")


# --- embeddings -------------------------------------------------------------------

_TASK_TEXT_SQL = "CASE role WHEN 'user' THEN 'query: ' || text WHEN 'assistant' THEN 'passage: ' || text ELSE text END"


def _task_texts(spark, sf_dir):
    role = F.col("role")
    prefix = F.when(role == "user", "query: ").when(role == "assistant", "passage: ").otherwise("")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(prefix, "text").alias("text"))


@query(
    "embedding_tasks",
    f"""WITH t AS (SELECT conv_id, turn, {_TASK_TEXT_SQL} AS text FROM conversations)
    SELECT conv_id, turn, CASE WHEN starts_with(text, 'query: ') THEN 'RETRIEVAL_QUERY' ELSE 'RETRIEVAL_DOCUMENT' END AS task,
      CASE WHEN starts_with(text, 'query: ') THEN text[8:] WHEN starts_with(text, 'passage: ') THEN text[10:] ELSE text END AS bare_text FROM t""",
)
def embedding_tasks(spark, sf_dir):
    return M.task_rows(_task_texts(spark, sf_dir)).select("conv_id", "turn", "task", "bare_text")


@query(
    "embedding_misses",
    f"""WITH t AS (SELECT role, {_TASK_TEXT_SQL} AS text, text AS bare FROM conversations),
    k AS (SELECT DISTINCT CASE WHEN role = 'user' THEN 'RETRIEVAL_QUERY' ELSE 'RETRIEVAL_DOCUMENT' END || ':' || sha256(bare) AS key, role FROM t)
    SELECT key FROM (SELECT DISTINCT key FROM k) WHERE key NOT IN (SELECT key FROM k WHERE role = 'assistant')""",
)
def embedding_misses(spark, sf_dir):
    """The store holds all assistant turns already."""
    keyed = M.task_rows(_task_texts(spark, sf_dir))
    roles = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    held = keyed.join(roles, ["conv_id", "turn"]).filter(F.col("role") == "assistant").select("key").distinct()
    return M.missing_embeddings(keyed, held).select("key")


def _store(spark, sf_dir):
    known = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("text")
    return M.run_model(M.task_rows(known).dropDuplicates(["key"]), M.hashed_trigram_embedder())


@query(
    "embedding_backfill",
    "SELECT doc_id, 'RETRIEVAL_DOCUMENT:' || sha256(text) AS key, CAST(64 AS INTEGER) AS dims FROM documents",
)
def embedding_backfill(spark, sf_dir):
    """Vectors for all documents; labelled ones come from the store."""
    filled, _ = M.backfill(table(spark, sf_dir, "documents").select("doc_id", "text"), _store(spark, sf_dir), M.hashed_trigram_embedder())
    return filled.select("doc_id", "key", F.size("embedding").alias("dims"))


# The stand-in model in SQL: hashed trigrams of code points with a sign, summed per dimension and normalised.
_MODEL_SQL = """
WITH u AS (SELECT doc_id, list_concat([32, 32], list_transform(string_split(lower(text), ''), lambda c: unicode(c)), [32]) AS u FROM documents),
h AS (SELECT doc_id, unnest(list_transform(range(1, len(u) - 1), lambda i: (u[i]::BIGINT * 961 + u[i + 1] * 31 + u[i + 2]) * 2654435761 % 4294967296)) AS h FROM u),
s AS (SELECT doc_id, h % 64 AS dim, sum(CASE WHEN h // 65536 % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS x FROM h GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM s GROUP BY doc_id)
"""


def _filled_store(spark, sf_dir):
    """A store that held the labelled documents before all were asked for."""
    store = M.vector_store(spark, shared_path(spark, "vectors"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return docs, store, M.embed_into(known, store, M.hashed_trigram_embedder()), M.embed_into(docs, store, M.hashed_trigram_embedder())


@query(
    "embedding_store",
    f"{_MODEL_SQL} SELECT doc_id, dim::INTEGER AS dim, round(CAST(CAST(x / CASE WHEN norm = 0 THEN 1 ELSE norm END AS FLOAT) AS DOUBLE), 6) AS x FROM s JOIN n USING (doc_id) WHERE x <> 0",
)
def embedding_store(spark, sf_dir):
    """Vectors of all documents, read back from the store."""
    docs, store, _, _ = _filled_store(spark, sf_dir)
    vectors = M.with_vectors(docs, store).select("doc_id", F.posexplode("embedding").alias("dim", "x")).filter("x <> 0")
    return vectors.select("doc_id", "dim", F.round(F.col("x").cast("double"), 6).alias("x"))


@query(
    "embedding_store_calls",
    """WITH k AS (SELECT count(DISTINCT text) AS n FROM documents JOIN labels USING (doc_id)), a AS (SELECT count(DISTINCT text) AS n FROM documents)
    SELECT 1 AS run, k.n AS asked FROM k UNION ALL SELECT 2, a.n - k.n FROM a, k""",
)
def embedding_store_calls(spark, sf_dir):
    """Texts the model was asked for: the second run leaves out what the first one stored."""
    _, _, first, second = _filled_store(spark, sf_dir)
    return spark.createDataFrame([(1, first.asked), (2, second.asked)], "run int, asked long")


@query("embedding_corpus_backfill", f"SELECT grant_id, has_vector AS had_vector, TRUE AS has_vector FROM ({_TARGET_SQL})")
def embedding_corpus_backfill(spark, sf_dir):
    """Stored documents before and after vectors are written back into the corpus."""
    corpus = corpus_table(spark, shared_path(spark, "corpus"))
    corpus.replace(stored_corpus(spark, sf_dir), 1)
    M.backfill_corpus(corpus, M.vector_store(spark, shared_path(spark, "vectors")), M.hashed_trigram_embedder())
    before, after = (corpus.read(v).select("grant_id", F.col("embedding").isNotNull().alias(n)) for v, n in ((1, "had_vector"), (2, "has_vector")))
    return before.join(after, "grant_id")


@query("embedding_refresh_totals", "SELECT count(*) AS embedded, CAST(0 AS BIGINT) AS failed FROM documents JOIN labels USING (doc_id)")
def embedding_refresh(spark, sf_dir):
    return M.embed_totals(M.re_embed(stored_corpus(spark, sf_dir), M.hashed_trigram_embedder()))


# --- enrichment -----------------------------------------------------------------------

# Every stored document with a label answers: some replies break a rule,
# toxic ones of low quality are no JSON at all.
_REPLY_SQL = f"""
SELECT 'g' || l.doc_id AS grant_id, l.quality = 0 AND l.toxic = 1 AS broken,
  CASE r.lang WHEN 'es' THEN 'tourism' WHEN 'fr' THEN NULL ELSE 'biotech' END AS sector,
  CASE WHEN l.toxic = 1 THEN ['saas', 'health', 'hardware', 'fintech', 'other'] ELSE ['saas'] END AS secondary_sectors,
  CASE WHEN r.lang = 'en' THEN 'Bayern' ELSE '' END AS federal_state, r.title AS application_notes,
  CASE WHEN r.n > 8000 THEN 'gift' WHEN r.n > 300 THEN 'grant' END AS funding_form
FROM labels l JOIN (SELECT doc_id, lang, title, CAST(funding_min_eur + 100 AS BIGINT) AS n FROM ({RECORDS_SQL})) r USING (doc_id)
"""
_REASONS_SQL = """concat_ws('; ',
  CASE WHEN broken THEN 'not a record' END,
  CASE WHEN NOT broken AND sector = 'tourism' THEN 'sector not allowed' END,
  CASE WHEN NOT broken AND funding_form = 'gift' THEN 'funding form not allowed' END,
  CASE WHEN NOT broken AND length(application_notes) > 600 THEN 'application_notes too long' END,
  CASE WHEN NOT broken AND len(secondary_sectors) > 4 THEN 'secondary_sectors longer than 4' END)"""


def _replies(spark, sf_dir):
    rows = records(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    toxic, lang, n = F.col("toxic") == 1, F.col("lang"), F.col("funding_min_eur") + 100
    many = F.array(*[F.lit(s) for s in ("saas", "health", "hardware", "fintech", "other")])
    record = F.struct(
        F.when(lang == "es", "tourism").when(lang == "fr", None).otherwise("biotech").alias("sector"),
        F.when(toxic, many).otherwise(F.array(F.lit("saas"))).alias("secondary_sectors"),
        F.when(lang == "en", "Bayern").otherwise("").alias("federal_state"),
        F.col("title").alias("application_notes"),
        F.when(n > 8000, "gift").when(n > 300, "grant").alias("funding_form"),
    )
    broken = toxic & (F.col("quality") == 0)
    reply = F.when(broken, F.lit("no answer today")).otherwise(F.concat(F.lit("```json\n"), F.to_json(record), F.lit("\n```")))
    return rows.select(F.concat(F.lit("g"), F.col("doc_id").cast("string")).alias("grant_id"), reply.alias("reply"))


def _checked(spark, sf_dir):
    return N.parse_enrichments(_replies(spark, sf_dir))


@query("enrichment_check", f"SELECT grant_id, {_REASONS_SQL} AS reasons FROM ({_REPLY_SQL})")
def enrichment_check(spark, sf_dir):
    return _checked(spark, sf_dir).select("grant_id", F.array_join("reasons", "; ").alias("reasons"))


@query(
    "enrichment_types",
    """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'target_groups is no list of texts' WHEN 1 THEN 'target_groups is no list of texts' WHEN 2 THEN 'sector not allowed; sector is no text'
      WHEN 3 THEN 'application_notes is no text' WHEN 4 THEN 'funding_phases is no list of texts' ELSE '' END AS reasons FROM documents""",
)
def enrichment_types(spark, sf_dir):
    """Replies whose fields hold a wrong kind of value; two of seven are right."""
    docs = table(spark, sf_dir, "documents")
    wrong = ['{"target_groups": "founders"}', '{"target_groups": ["SMEs", 3]}', '{"sector": 5}', '{"application_notes": null}', '{"funding_phases": null}', '{"sector": null}', '{"target_groups": []}']
    reply = F.element_at(F.array(*[F.lit(w) for w in wrong]), (F.col("doc_id") % 7 + 1).cast("int"))
    checked = N.parse_enrichments(docs.select(F.col("doc_id").alias("grant_id"), reply.alias("reply")))
    return checked.select(F.col("grant_id").alias("doc_id"), F.array_join("reasons", "; ").alias("reasons"))


@query(
    "enrichment_work_list",
    f"SELECT grant_id, funding_form IS NULL AS due FROM ({_TARGET_SQL})",
)
def enrichment_work_list(spark, sf_dir):
    return N.work_list(stored_corpus(spark, sf_dir)).select("grant_id", "due")


@query(
    "enrichment_merge",
    f"""SELECT t.grant_id, CASE WHEN ok THEN coalesce(t.sector, r.sector) ELSE t.sector END AS sector,
      CASE WHEN ok THEN coalesce(t.federal_state, nullif(r.federal_state, '')) ELSE t.federal_state END AS federal_state,
      CASE WHEN ok THEN coalesce(r.funding_form, 'other') ELSE t.funding_form END AS funding_form,
      CASE WHEN ok THEN r.application_notes WHEN t.funding_form IS NOT NULL THEN '' END AS application_notes,
      CAST(CASE WHEN ok OR t.funding_form IS NOT NULL THEN 1 END AS INTEGER) AS version
    FROM ({_TARGET_SQL}) t JOIN (SELECT *, {_REASONS_SQL} = '' AS ok FROM ({_REPLY_SQL})) r USING (grant_id)""",
)
def enrichment_merge(spark, sf_dir):
    merged = N.merge_enrichments(stored_corpus(spark, sf_dir), _checked(spark, sf_dir), F.lit(_NOW).cast("timestamp"))
    return merged.select(
        "grant_id", "sector", "federal_state", "eligibility.funding_form", "eligibility.application_notes",
        F.col("eligibility.enrichment_version").alias("version"),
    )


@query(
    "enrichment_tally",
    f"""SELECT CASE WHEN t.funding_form IS NOT NULL THEN 'skipped' WHEN {_REASONS_SQL} = '' THEN 'enriched' ELSE 'failed' END AS status, count(*) AS n
    FROM (SELECT grant_id, funding_form FROM ({_TARGET_SQL})) t JOIN ({_REPLY_SQL.replace("funding_form", "reply_form")}) r USING (grant_id) GROUP BY ALL""".replace(
        "NOT broken AND funding_form = 'gift'", "NOT broken AND reply_form = 'gift'"
    ),
)
def enrichment_tally(spark, sf_dir):
    work = N.work_list(stored_corpus(spark, sf_dir))
    return N.enrichment_tally(N.enrichment_outcomes(work, _checked(spark, sf_dir)))


@query(
    "secret_scrub",
    r"""SELECT page_id, regexp_replace(replace(url, '?page=', '?key=AB-c_'), '[?&]key=[A-Za-z0-9_\-]+', '?key=<redacted>', 'g') AS url FROM pages""",
)
def secret_scrub(spark, sf_dir):
    url = F.replace(F.col("url"), F.lit("?page="), F.lit("?key=AB-c_"))
    return table(spark, sf_dir, "pages").select("page_id", X.scrub_secrets(url).alias("url"))
