"""All queries of the engine itself, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..streaming import queries as streams
from . import flow_queries, ledger_views, report_queries, retrieval, step_queries

PARTS = (retrieval, ledger_views, step_queries, flow_queries, report_queries, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in PARTS for name, f in part.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
