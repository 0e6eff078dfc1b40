"""All registered queries."""

from sessionloom.plans import (  # noqa: F401
    score_queries,
    session_queries,
    table_queries,
    text_queries,
    whole_queries,
)
from sessionloom.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
