"""Queries over the test tables, grouped as the operators are; each with the SQL that expresses it where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from ..session import ship, small_tasks

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query (spark, sf_dir) -> DataFrame under its own name, with its SQL."""

    def register(f: Callable) -> Callable:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")

        @wraps(f)
        def run(spark, sf_dir):
            ship(spark)
            small_tasks(spark, sf_dir)
            return f(spark, sf_dir)

        QUERIES[key] = run
        if sql:
            ORACLES[key] = sql
        return f

    return register
