"""The whole audit of a batch of labels, from tokens to decisions, violations and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import classify, compliance, extract, rules


def as_declarations(extracted: DataFrame) -> DataFrame:
    """Extracted rows as the rules expect them: what is missing is null, and the maker's field has the rules' name."""
    name = F.when(F.col("field_type") == "manufacturer", "manufacturer_name").otherwise(F.col("field_type"))
    return extracted.select("inspection_id", name.alias("field_type"), F.when(F.col("value") != extract.MISSING, F.col("value")).alias("text"), "confidence", "ord")


def latest_quality(images: DataFrame) -> DataFrame:
    """Of each inspection the latest image and its quality: id (the inspection's), image_id, quality_score."""
    rows = images.select(F.col("inspection_id").alias("of"), F.col("id").alias("image_id"), "quality_score", "uploaded_at")
    latest = rows.groupBy("of").agg(F.max_by(F.struct("image_id", "quality_score"), F.struct("uploaded_at", "image_id")).alias("i"))
    return latest.select(F.col("of").alias("id"), "i.image_id", "i.quality_score")


def text_of(field: Column) -> Column:
    """The text of the surest of a row's ``declarations`` of that field (null is 0), of equals the first."""
    some, sure = F.filter("declarations", lambda x: x["field_type"] == field), lambda x: F.coalesce(x["confidence"], F.lit(0.0))
    return F.aggregate(some, F.get(some, 0), lambda a, x: F.when(sure(x) > sure(a), x).otherwise(a))["text"]


def run_pipeline(tokens: DataFrame, inspections: DataFrame, rule_versions: DataFrame, images: DataFrame, model: classify.NameModel) -> DataFrame:
    """All stages for inspections (id, product_name, package_type, day), their recognised tokens and their images (id,
    inspection_id, uploaded_at, quality_score): extraction, classification by a stored model, the rules of that category on
    that day, the decision, its violations and their evidence, and the workflow status.

    One row for each inspection, those without tokens or images too: inspection_id, category, category_confidence,
    needs_manual_selection, overall_status, status_reason, n_extracted, n_pass, n_fail, n_na, status, violations, evidence,
    n_evidence, warnings. An inspection's declarations stay in one row from the extraction to the rules, so that tokens are
    read, and labels classified, once; only tokens, images and inspections are shuffled, each by inspection.
    """
    declared = extract.gathered_declarations(extract.normalize_tokens(tokens)).select(F.col("inspection_id").alias("id"), "found")
    rows = inspections.select("id", "product_name", "package_type", "day").join(declared, "id", "left").join(latest_quality(images), "id", "left")
    name = lambda x: F.when(x["field_type"] == "manufacturer", "manufacturer_name").otherwise(x["field_type"])
    declaration = lambda x: F.struct(name(x).alias("field_type"), F.when(x["value"] != extract.MISSING, x["value"]).alias("text"), x["confidence"].alias("confidence"))
    rows = rows.withColumn("declarations", F.coalesce(F.transform("found", declaration), F.array())).drop("found")
    texts = F.array_compact(F.transform("declarations", lambda x: x["text"]))
    rows = rows.withColumn("n_extracted", F.size(F.filter(texts, lambda x: x != ""))).withColumn("text", F.trim(F.concat_ws(" ", "product_name", F.nullif(F.array_join(texts, " "), F.lit("")))))
    rows = classify.route_category(classify.classify(rows, model)).withColumnsRenamed({"path": "category", "confidence": "category_confidence"})
    also = ("category", "category_confidence", "needs_manual_selection", "n_extracted", "image_id", "quality_score")
    seen = rules.applicable_rules(rows.select("id", "package_type", "day", "declarations", *also), rule_versions, spare=True)
    verdicts = rules.verdicts(seen.withColumn("text", text_of(F.col("field"))), *also)
    kept = ("category", "category_confidence", "needs_manual_selection", "quality_score")
    out = compliance.pipeline_warnings(compliance.concluded(compliance.gathered_verdicts(verdicts, *also), *kept))
    return out.select(
        "inspection_id", "category", "category_confidence", "needs_manual_selection", "overall_status", "status_reason", "n_extracted", "n_pass", "n_fail", "n_na", compliance.inspection_status(F.col("overall_status")).alias("status"),
        "violations", "evidence", F.size("evidence").alias("n_evidence"), F.array_compact(F.array("warning")).alias("warnings"),
    )
