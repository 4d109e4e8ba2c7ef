"""All registered queries with their SQL twins."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


for _module in ("documentation", "statistics", "text", "collection", "reports"):
    import_module(f"twinframe.plans.{_module}")
