"""Imports every module of queries; the registry then holds them all."""

from __future__ import annotations

from tenderscope.plans import (  # noqa: F401
    cleaning,
    decisions,
    documents,
    learning,
    market,
    matching,
    network,
    series,
    streams,
)
from tenderscope.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
