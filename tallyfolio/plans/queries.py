"""All registered queries (importing the modules registers them)."""

from __future__ import annotations

from tallyfolio.plans import (evidence_queries, inference_queries, intake_queries, merge_queries,  # noqa: F401
                              store_queries, stream_queries, text_queries)
from tallyfolio.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
