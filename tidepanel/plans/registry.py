"""Named queries and, where there is one, their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None, name: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame under ``name`` or ``key``."""
    def register(f: Callable) -> Callable:
        QUERIES[name or key] = f
        if sql:
            SQL[name or key] = sql
        return f

    return register
