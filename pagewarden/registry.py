"""All queries of the reference's operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import plans
from .plans import event_queries, form_queries, geometry_queries, hidden_queries, multipart_queries, order_queries, page_queries, plan_queries, request_queries, step_queries, text_queries  # noqa: F401  (they register their queries)

FLAGSHIP = "t3_sanitize_documents"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return plans.QUERIES


def oracle_sql() -> dict[str, str]:
    return plans.ORACLE_SQL
