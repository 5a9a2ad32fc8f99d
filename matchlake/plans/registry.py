"""Where queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from matchlake.plans.base_sql import sql

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(body: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under its name, with SQL over the proxy views."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if body:
            SQL[f.__name__] = sql(body)
        return f

    return add
