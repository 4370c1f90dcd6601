"""Operators for training-data pipelines; nothing else in the library imports them."""

from subventa.llm import (  # noqa: F401
    q_chat,
    q_embeddings,
    q_importance,
    q_maintext,
    q_merkle,
    q_minhash,
    q_packing,
    q_pieces,
    q_quality,
    q_secrets,
    q_templates,
    q_token_counts,
    q_warc,
)
from subventa.llm.registry import ORACLES, QUERIES  # noqa: F401
