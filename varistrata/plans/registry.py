"""All queries of the engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its name; a name can be taken once."""

    def add(fn: Callable) -> Callable:
        if fn.__name__ in QUERIES:
            raise ValueError(f"there is a query {fn.__name__} already")
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


from varistrata.plans import grids, models, relational, statistics, surface, tables  # noqa: E402, F401
