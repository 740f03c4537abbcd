"""Named queries of the engine and the SQL that checks them; the modules below fill both."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir)`` under ``name``, with SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


from quillspark.plans import evaluation_queries, graph_queries, profile_queries, search_queries, work_queries  # noqa: E402,F401
