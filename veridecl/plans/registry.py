"""All queries over the driver's tables, by name, with the SQL that DuckDB runs for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapters import view

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with SQL that gives the same rows."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inspections as the rules see them: id, category, package_type, day."""
    products = view(spark, sf_dir, "products_v").select(F.col("id").alias("product_id"), "category")
    return view(spark, sf_dir, "inspections_v").join(products, "product_id", "left").select("id", "category", "package_type", F.to_date("created_at").alias("day"))


def queries() -> dict[str, Query]:
    from . import audit_queries, entity_queries, geometry_queries, label_queries, rule_queries, stream_queries  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
