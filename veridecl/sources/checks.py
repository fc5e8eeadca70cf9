"""Scans of all entities that tell what is wrong with them: columns, types, keys, values, and keys between entities."""

from __future__ import annotations

import functools

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .schemas import SCHEMAS

# What a column may hold.
VALUES = {
    ("users", "role"): ["inspector", "senior_officer", "admin"],
    ("inspections", "overall_status"): ["COMPLIANT", "NON_COMPLIANT", "PARTIALLY_COMPLIANT", "NEEDS_HUMAN_REVIEW", "INSUFFICIENT_EVIDENCE"],
    ("compliance_checks", "verdict"): ["pass", "fail", "needs_review", "not_applicable"],
    ("violations", "severity"): ["critical", "major", "minor"],
}
#: Columns that hold the id of another entity.
REFERENCES = {
    ("categories", "parent_id"): "categories",
    ("products", "category_id"): "categories",
    ("products", "previous_inspection_id"): "inspections",
    ("inspections", "product_id"): "products",
    ("inspections", "inspector_id"): "users",
    ("images", "inspection_id"): "inspections",
    ("ocr_results", "image_id"): "images",
    ("declarations", "inspection_id"): "inspections",
    ("declarations", "source_ocr_result_id"): "ocr_results",
    ("rule_versions", "rule_id"): "rules",
    ("rule_versions", "published_by"): "users",
    ("compliance_checks", "inspection_id"): "inspections",
    ("compliance_checks", "rule_version_id"): "rule_versions",
    ("compliance_checks", "declaration_id"): "declarations",
    ("violations", "inspection_id"): "inspections",
    ("violations", "compliance_check_id"): "compliance_checks",
    ("evidence", "violation_id"): "violations",
    ("evidence", "image_id"): "images",
    ("corrections", "declaration_id"): "declarations",
    ("corrections", "compliance_check_id"): "compliance_checks",
    ("corrections", "corrected_by"): "users",
    ("reports", "inspection_id"): "inspections",
    ("reports", "generated_by"): "users",
    ("audit_logs", "actor_id"): "users",
}
ISSUES = "entity string, issue string, field string, n long"


def column_issues(spark: SparkSession, folder: str, name: str) -> tuple[list[tuple[str, str, str, int]], DataFrame | None]:
    """What is wrong with the columns of one entity's table, from its files' schema only, and the table with the columns
    that are right; columns of another type are left out of it, or cast where that loses nothing."""
    want = StructType.fromDDL(SCHEMAS[name])
    try:
        rows = spark.read.parquet(f"{folder}/{name}.parquet")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return [(name, "missing_table", "", 1)], None
    have = {f.name: f.dataType for f in rows.schema}
    found, fit = [], []
    for field in want:
        if field.name not in have:
            found.append((name, "missing_column", field.name, 1))
        elif have[field.name].simpleString() != field.dataType.simpleString():
            found.append((name, "type", field.name, 1))
            if field.dataType.simpleString() == "string":
                fit.append(F.col(f"`{field.name}`").cast("string").alias(field.name))
        else:
            fit.append(F.col(f"`{field.name}`"))
    found += [(name, "unknown_column", column, 1) for column in have if column not in want.names]
    return found, rows.select(*fit)


def _key_issues(name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Ids of one entity that stand more than once, and rows of each reference to it that find none.

    Ids and references are counted together by their value, so nothing is joined or broadcast, however small a table
    looks to the planner, and a value that many rows hold is one row of each task.
    """
    held = [(of, c) for (of, c), other in REFERENCES.items() if other == name and of in tables and c in tables[of].columns]
    # 0 marks the entity's own ids
    keys = [tables[name].select("id", F.lit(0).alias("k"))] + [tables[of].select(F.col(c).alias("id"), F.lit(k).alias("k")) for k, (of, c) in enumerate(held, 1)]
    counts = [F.count_if(F.col("k") == k).alias(f"n{k}") for k in range(len(keys))]
    met = functools.reduce(DataFrame.unionByName, keys).filter("id is not null").groupBy("id").agg(*counts)
    issue = lambda entity, issue, field, n: F.struct(F.lit(entity).alias("entity"), F.lit(issue).alias("issue"), F.lit(field).alias("field"), n.alias("n"))
    found = [issue(name, "duplicate_key", "id", F.count_if(F.col("n0") > 1))]
    found += [issue(of, "orphan", c, F.coalesce(F.sum(F.when(F.col("n0") == 0, F.col(f"n{k}"))), F.lit(0))) for k, (of, c) in enumerate(held, 1)]
    return met.agg(F.array(*found).alias("all")).select(F.inline("all"))


def check_entities(spark: SparkSession, folder: str) -> DataFrame:
    """All that is wrong with the tables of all entities in a folder, as rows (entity, issue, field, n).

    missing_table, missing_column, unknown_column and type come from the files' schemas; null_key and bad_value (rows with a
    value that the column may not hold) from one scan of each table, of the columns that are looked at; duplicate_key (ids
    that stand more than once) and orphan (rows whose reference has no row in the other entity) from one grouping for each
    entity, of its ids and all that refers to them. A null reference or value is no fault. Rows with n = 0 are left out.
    """
    issues: list[tuple[str, str, str, int]] = []
    tables: dict[str, DataFrame] = {}
    for name in SCHEMAS:
        found, rows = column_issues(spark, folder, name)
        issues += found
        if rows is not None:
            tables[name] = rows
    parts = [spark.createDataFrame(issues, ISSUES)]
    for name, rows in tables.items():
        if "id" in rows.columns:
            parts.append(_key_issues(name, tables))
        tests = {("null_key", "id"): F.col("id").isNull()} if "id" in rows.columns else {}
        tests |= {("bad_value", c): ~F.col(c).isin(*allowed) for (of, c), allowed in VALUES.items() if of == name and c in rows.columns}
        if tests:
            counts = F.array(*[F.struct(F.lit(issue).alias("issue"), F.lit(c).alias("field"), F.count_if(F.coalesce(test, F.lit(False))).alias("n")) for (issue, c), test in tests.items()])
            parts.append(rows.agg(counts.alias("all")).select(F.lit(name).alias("entity"), F.inline("all")))
    return functools.reduce(DataFrame.unionByName, parts).filter("n > 0")
