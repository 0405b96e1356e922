"""Queries by id, each with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def with_ctes(*parts: str, recursive: bool = False) -> str:
    """Shared table expressions, then a query that may open with more of its own."""
    *ctes, body = (part.strip() for part in parts)
    joint = "\n" if body.startswith("SELECT") else ",\n"
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + joint + body
