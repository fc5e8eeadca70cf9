"""Key figures, trends and category rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _status(*names: str) -> Column:
    return F.upper("overall_status").isin(*names)


_BAD = ("NON_COMPLIANT", "FLAGGED_FOR_REVIEW")


def _rate(good: Column, all_: Column) -> Column:
    return F.when(all_ > 0, F.round(good / all_ * 100, 1)).otherwise(0.0)


def kpis(inspections: DataFrame, products: DataFrame) -> DataFrame:
    """All key figures in one pass over the inspections."""
    n = lambda *s: F.count_if(_status(*s))
    row = inspections.agg(F.count("*").alias("total_inspections"), n("COMPLIANT").alias("compliant"), n("NON_COMPLIANT").alias("non_compliant"), n("FLAGGED_FOR_REVIEW").alias("flagged"), n("NEEDS_HUMAN_REVIEW").alias("needs_review"))
    row = row.withColumn("active_violations", F.col("non_compliant") + F.col("flagged")).withColumn("compliance_rate", _rate(F.col("compliant"), F.col("compliant") + F.col("non_compliant") + F.col("flagged")))
    return row.crossJoin(F.broadcast(products.agg(F.count("*").alias("total_products"))))


def top_category(inspections: DataFrame, products: DataFrame) -> DataFrame:
    bad = inspections.filter(_status(*_BAD)).join(products.select(F.col("id").alias("product_id"), "category"), "product_id")
    return bad.filter("category is not null").groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(1)


def trends(inspections: DataFrame) -> DataFrame:
    """Every month between the first and last inspection, with those of the month and the share that complied."""
    counts = inspections.groupBy(F.trunc("created_at", "month").alias("month")).agg(F.count("*").alias("total"), F.count_if(_status("COMPLIANT")).alias("compliant"), F.count_if(_status(*_BAD)).alias("bad"))
    spine = counts.agg(F.min("month").alias("lo"), F.max("month").alias("hi")).select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month"))
    rows = spine.join(counts, "month", "left").fillna(0, ["total", "compliant", "bad"])
    estimate = F.floor(F.col("total") * F.lit(0.8)).alias("compliant_estimate")
    return rows.select(F.date_format("month", "yyyy-MM").alias("month"), "total", "compliant", "bad", _rate(F.col("compliant"), F.col("total")).alias("rate"), estimate)


def category_rates(inspections: DataFrame, products: DataFrame) -> DataFrame:
    """Per category its inspections and how many failed, with the total of all."""
    rows = products.select(F.col("id").alias("product_id"), F.coalesce("category", F.lit("Uncategorized")).alias("category")).join(inspections.select("product_id", "id", "overall_status"), "product_id", "left")
    out = rows.groupBy("category").agg(F.count("id").alias("inspections"), F.count_if(_status(*_BAD)).alias("violations"))
    total = out.agg(F.sum("inspections").alias("total"))
    return out.withColumn("violation_rate", _rate(F.col("violations"), F.col("inspections"))).crossJoin(F.broadcast(total))
