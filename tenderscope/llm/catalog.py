"""Imports every module of queries of this subpackage."""

from __future__ import annotations

from tenderscope.llm import (  # noqa: F401
    q_benchmark,
    q_conversations,
    q_language,
    q_languages,
    q_licenses,
    q_near,
    q_pii,
    q_secrets,
    q_tokens,
    q_toxicity,
    q_urls,
    q_vectors,
    q_whitening,
)
from tenderscope.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
