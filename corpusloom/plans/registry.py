"""Registered queries: name, Spark plan and, where SQL can say it, the DuckDB twin."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans.oracle import statement
from corpusloom.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(*names: str, sql: str | None = None):
    """Register a plan under one or more names with its SQL twin."""

    def add(plan):
        @functools.wraps(plan)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return plan(spark, sf_dir)

        for name in names:
            QUERIES[name] = run
            if sql is not None:
                ORACLES[name] = statement(sql)
        return plan

    return add


def load() -> None:
    """Import every module that registers queries."""
    from corpusloom.plans import (  # noqa: F401
        agent_queries,
        conversation_queries,
        file_queries,
        reply_queries,
        search_queries,
        store_queries,
    )
