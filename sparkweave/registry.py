"""All queries of the library outside the llm subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkweave.queries import candidate_queries, fragments, metric_queries, report_queries, run_queries, searches, source_queries, stat_queries, summary_queries, table_queries  # noqa: F401
from sparkweave.queries.base import ORACLE, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
