"""Registry of the queries over the given tables and of their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netquill.plans import alert_queries, detect_queries, rule_queries, stream_queries

FLAGSHIP = "e13_brute_force"
_PARTS = (detect_queries, alert_queries, stream_queries, rule_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for part in _PARTS for k, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in _PARTS for k, s in part.SQL.items()}
