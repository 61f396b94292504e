"""All registered queries and their SQL."""

from __future__ import annotations

from . import (  # noqa: F401
    artifact_queries,
    claim_queries,
    detect_queries,
    receipt_queries,
    replay_queries,
    scoring_queries,
    search_queries,
)
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
