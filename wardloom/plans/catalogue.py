"""Registry of the core queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardloom.plans import analytics, data, planning, searching, ward
from wardloom.session import Query

MODULES = (data, ward, analytics, planning, searching)


def queries() -> dict[str, Query]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of every ward-day under the five evidence strategies."""
    return analytics.coverage_cells(spark, sf_dir)
