"""Registry of catalogue queries: a Spark callable and the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.sources.views import VIEW_SQL, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def with_views(sql: str) -> str:
    """``sql`` preceded by the definitions of the views it names."""
    needed: dict[str, str] = {}

    def add(text: str) -> None:
        for name, body in VIEW_SQL.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                add(body)
                needed.setdefault(name, body)

    add(sql)
    ctes = ", ".join(f"{n} AS ({b})" for n, b in needed.items())
    if not ctes:
        return sql
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    if own:
        return f"WITH {own.group(1) or ''}{ctes}, {sql[own.end() :]}"
    return f"WITH {ctes} {sql}"


def query(name: str, sql: str | None = None):
    """Register a function of the views under ``name``."""

    def put(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql)
        return build

    return put
