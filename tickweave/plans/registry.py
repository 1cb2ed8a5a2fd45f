"""Names of the registered queries, each with the SQL that states the same result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SQL_VIEWS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def sql_view(name: str, body: str) -> None:
    SQL_VIEWS[name] = body.strip()


def with_views(sql: str) -> str:
    """Put the views a statement mentions in front of it, dependencies first."""
    if sql.lstrip().startswith("WITH RECURSIVE"):
        return sql
    order: list[str] = []

    def visit(text: str, path: tuple[str, ...] = ()) -> None:
        for name in SQL_VIEWS:
            if name not in order and name not in path and re.search(rf"\b{name}\b", text):
                visit(SQL_VIEWS[name], (*path, name))
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql
    views = ",\n".join(f"{name} AS ({SQL_VIEWS[name]})" for name in order)
    own = sql.strip()
    if own.startswith("WITH "):
        return f"WITH {views},\n{own.removeprefix('WITH ')}"
    return f"WITH {views}\n{own}"


def r6(expr: str) -> str:
    """SQL text for six decimals without a negative zero."""
    return f"(round({expr}, 6) + 0.0)"
