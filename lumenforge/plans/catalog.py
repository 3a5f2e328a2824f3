"""Queries of the analytics core and, where SQL can express them, their oracles.

Keys begin with the ids of the operators that a query covers. Modules of this
package register their queries here when they are imported.
"""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; sql: the same in DuckDB's dialect."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def load() -> None:
    for module in ("decisions", "corpora", "bytes", "pixels", "signals", "addresses", "live", "documents"):
        if importlib.util.find_spec(f"lumenforge.plans.{module}"):
            importlib.import_module(f"lumenforge.plans.{module}")
