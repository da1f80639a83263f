"""Query catalogue: each entry pairs a Spark job with its SQL twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from demandloom.catalog.prelude import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Prefix a statement with the domain views it (transitively) names."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        words = set(re.findall(r"\b[a-z_0-9]+\b", text))
        for name in VIEWS:
            if name in words and name not in needed:
                needed.add(name)
                visit(VIEWS[name])

    visit(sql)
    ordered = [f"{name} AS ({body})" for name, body in VIEWS.items() if name in needed]
    if not ordered:
        return sql
    body = sql.strip()
    for prefix in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(prefix):
            body = ",\n" + body[len(prefix):]
            break
    return "WITH RECURSIVE " + ",\n".join(ordered) + "\n" + body


def query(name: str, sql: str | None = None):
    """Register ``fn(domain) -> DataFrame`` under ``name``; ``sql`` is its DuckDB twin."""
    from demandloom.catalog.domain import Retail

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Retail(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register
