"""Registered queries: a Spark form for each operator and, where SQL can say it, an oracle."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.session import guard_batches, guard_unions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
GROUPS = ["sources", "text", "chunks", "retrieval", "rules", "graph", "metrics", "memory", "streams", "hooks"]


def query(name: str, sql: str | None = None):
    """Register a query under its inventory name."""
    def register(build: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")

        def guarded(spark: SparkSession, sf: str) -> DataFrame:
            guard_unions(spark)
            guard_batches(spark)
            return build(spark, sf)

        QUERIES[name] = guarded
        if sql is not None:
            ORACLES[name] = sql.strip()
        return build

    return register


def load() -> None:
    for group in GROUPS:
        importlib.import_module(f"catalog.{group}")
