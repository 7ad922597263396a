"""All queries by name, each a function of (spark, folder of tables), and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def load() -> None:
    """Imports the modules that hold the queries."""
    from plycast.plans import corpus, dump, logs, positions, prompts, scores, squares, streams, texts  # noqa: F401
