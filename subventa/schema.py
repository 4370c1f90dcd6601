"""Declared schemas and allowed values. Nothing is inferred at query time."""

from __future__ import annotations

from pyspark.sql import types as T

# Allowed enum values (fixed values; stored lower-case).
PORTALS = ("bmbf", "exist", "kfw", "eic", "horizon", "bayern", "nrw", "bw")
STATUSES = ("open", "closed", "upcoming", "rolling")
SECTORS = ("deeptech", "cleantech", "health", "biotech", "saas", "hardware", "ai_ml", "fintech", "other")
STAGES = ("idea", "pre_seed", "seed", "series_a", "growth")
FUNDING_FORMS = ("grant", "loan", "equity", "stipend", "mixed", "other")
FINDING_TYPES = (
    "citation_faithfulness",
    "fit_alignment",
    "caveat_omission",
    "language_mismatch",
    "profile_misuse",
    "other",
)

# Current enrichment version (fixed value).
ENRICHMENT_VERSION = 1

MONEY = T.DecimalType(14, 2)
_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


ELIGIBILITY = _struct(
    ("target_groups", T.ArrayType(_S)),
    ("criteria", T.ArrayType(_S)),
    ("funding_phases", T.ArrayType(_S)),
    ("funding_form", _S),
    ("secondary_sectors", T.ArrayType(_S)),
    ("application_notes", _S),
    ("enrichment_version", T.IntegerType()),
    ("enriched_at", _TS),
)

CORPUS = _struct(
    ("grant_id", _S),
    ("portal", _S),
    ("status", _S),
    ("sector", _S),
    ("country", _S),
    ("federal_state", _S),
    ("title", _S),
    ("title_en", _S),
    ("summary", _S),
    ("summary_en", _S),
    ("body", _S),
    ("funding_min_eur", MONEY),
    ("funding_max_eur", MONEY),
    ("deadline", _TS),
    ("opens_at", _TS),
    ("eligibility", ELIGIBILITY),
    ("metadata", T.MapType(_S, _S)),
    ("embedding", T.ArrayType(T.FloatType())),
    ("source_url", _S),
    ("source_doc_id", _S),
    ("source_hash", _S),
    ("created_at", _TS),
    ("updated_at", _TS),
    ("deleted_at", _TS),
)

# One validated record of an ingest batch; `arrival` orders repeated urls.
ARRIVAL = _struct(
    ("arrival", _L),
    ("portal", _S),
    ("source_url", _S),
    ("source_doc_id", _S),
    ("title", _S),
    ("title_en", _S),
    ("summary", _S),
    ("summary_en", _S),
    ("body", _S),
    ("status", _S),
    ("sector", _S),
    ("country", _S),
    ("federal_state", _S),
    ("funding_min_eur", T.DecimalType(38, 6)),
    ("funding_max_eur", T.DecimalType(38, 6)),
    ("deadline", _TS),
    ("opens_at", _TS),
    ("eligibility", ELIGIBILITY),
    ("metadata", T.MapType(_S, _S)),
)

PAGE = _struct(("page_id", _L), ("url", _S), ("html", _S))

RUN_LEDGER = _struct(
    ("run_id", _S),
    ("portal", _S),
    ("trigger", _S),
    ("status", _S),
    ("started_at", _TS),
    ("finished_at", _TS),
    ("duration_ms", _L),
    ("inserted", _L),
    ("updated", _L),
    ("skipped_unchanged", _L),
    ("failed", _L),
    ("embedded", T.BooleanType()),
    ("error", _S),
    ("error_type", _S),
)

GOLD_QUERY = _struct(
    ("qid", _S),
    ("lang", _S),
    ("query", _S),
    ("ideal", T.ArrayType(_S)),
    ("relevant", T.ArrayType(_S)),
    ("rationale", _S),
)

EVAL_ROW = _struct(
    ("qid", _S),
    ("config_label", _S),
    ("mode", _S),
    ("use_hyde", T.BooleanType()),
    ("elapsed_ms", _L),
    ("ranked", T.ArrayType(_S)),
    ("precision_5", _D),
    ("recall_10", _D),
    ("ndcg_10", _D),
    ("mrr_lenient", _D),
    ("mrr_strict", _D),
)

ENRICHMENT = _struct(
    ("sector", _S),
    ("secondary_sectors", T.ArrayType(_S)),
    ("federal_state", _S),
    ("target_groups", T.ArrayType(_S)),
    ("eligibility_criteria", T.ArrayType(_S)),
    ("funding_phases", T.ArrayType(_S)),
    ("funding_form", _S),
    ("application_notes", _S),
)

PLANNER = _struct(
    ("rewritten_query", _S),
    (
        "facts",
        _struct(
            ("sector", _S),
            ("stage", _S),
            ("country", _S),
            ("federal_state", _S),
            ("funding_target_eur", _L),
        ),
    ),
    ("rationale", _S),
)

# Scores and labels arrive as free text and are normalised by functions.labels.
SCORER = _struct(
    (
        "scores",
        T.ArrayType(
            _struct(
                ("grant_id", _S),
                ("eligibility_score", _S),
                ("fit_label", _S),
                ("strengths", T.ArrayType(_S)),
                ("concerns", T.ArrayType(_S)),
                ("missing_info", T.ArrayType(_S)),
            )
        ),
    ),
)

CRITIC = _struct(
    ("overall_pass", T.BooleanType()),
    ("summary", _S),
    (
        "findings",
        T.ArrayType(_struct(("type", _S), ("severity", _S), ("grant_id", _S), ("message", _S))),
    ),
)

WRITER = _struct(
    ("summary", _S),
    (
        "recommendations",
        T.ArrayType(
            _struct(
                ("grant_id", _S),
                ("grant_title", _S),
                ("portal", _S),
                ("source_url", _S),
                ("fit", _S),
                ("rationale", _S),
                ("caveats", T.ArrayType(_S)),
            )
        ),
    ),
    ("questions_for_user", T.ArrayType(_S)),
)
