"""Registered queries: each pairs a Spark plan over the driver's tables with DuckDB SQL for the same result."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODULES = ["files", "circuits", "graphs", "sweeps", "frames", "reports", "learning", "models", "scores"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def load() -> None:
    for module in MODULES:
        import_module(f"gatelens.catalog.{module}")
