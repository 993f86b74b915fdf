"""Where queries and their SQL twins are entered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def enter(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return enter


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def values(rows) -> str:
    """A VALUES list; floats are written as doubles, tuples and lists as lists."""

    def one(x):
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, float):
            return f"{x!r}" if "e" in repr(x) else f"{x!r}e0"
        if isinstance(x, str):
            return q(x)
        if isinstance(x, (list, tuple)):
            return "CAST([" + ", ".join(map(one, x)) + "] AS VARCHAR[])"
        return str(x)

    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)
