"""Registry of checked queries: name -> (Spark callable, SQL text or None)."""

from __future__ import annotations

from collections.abc import Callable

from .views import with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] | str = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` with the SQL that must give the same rows."""
    views = (views,) if isinstance(views, str) else tuple(views)

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return fn
    return register
