"""Registered queries, each with its SQL."""

from matchlake.plans import audits, catalog, usage  # noqa: F401
from matchlake.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
