"""Registry of named queries, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}
_DECIMAL = re.compile(r"(?<![\w.])(\d+\.\d+)(?![\w.])")


def double_literals(sql: str) -> str:
    """Write 0.5 as 0.5e0 outside quotes: DuckDB reads a bare 0.5 as DECIMAL, Spark's side is double."""
    parts = sql.split("'")
    parts[::2] = [_DECIMAL.sub(r"\1e0", p) for p in parts[::2]]
    return "'".join(parts)


def query(name: str, ids: str, sql: str | None = None):
    def add(fn: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, ids, fn, double_literals(sql) if sql else None)
        return fn

    return add
