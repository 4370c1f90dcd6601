"""Registered queries over the given tables."""

from subventa.plans import activity, corpora, extraction, ingestion, quality, replies, search, standing, statistics  # noqa: F401
from subventa.plans.registry import ORACLES, QUERIES  # noqa: F401
