"""All queries of this subpackage (importing the modules registers them)."""

from __future__ import annotations

from tallyfolio.llm import classifier_queries, dedup_queries, page_queries, text_queries, token_queries  # noqa: F401
from tallyfolio.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
