"""All registered queries."""

from __future__ import annotations

from cohort.plans import (duplicate_queries, evaluation_queries, image_queries,  # noqa: F401
                          preparation_queries, privacy_queries, profile_queries, stream_queries)
from cohort.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
