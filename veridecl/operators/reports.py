"""Report facts, their export, and due reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import compliance as co
from .rules import small

#: Passed fields below it are told as doubtful, and declarations below it get a note.
LOW_CONFIDENCE = 0.5


def declaration_facts(declarations: DataFrame) -> DataFrame:
    """Of each inspection how many declarations have a text, and notes on those read with little confidence, by their
    order (field_type, text, confidence); one without a confidence counts as sure."""
    low = F.coalesce("confidence", F.lit(1.0)) < LOW_CONFIDENCE
    notes = F.array_sort(F.collect_list(F.when(low, F.struct("ord", "field_type", "text", "confidence"))))
    facts = declarations.groupBy("inspection_id").agg(F.count_if(F.length("text") > 0).alias("n_extracted"), notes.alias("notes"))
    return facts.withColumn("notes", F.transform("notes", lambda x: F.struct(*(x[c].alias(c) for c in ("field_type", "text", "confidence")))))


def report_facts(inspections: DataFrame, verdicts: DataFrame, declarations: DataFrame, images: DataFrame, references: DataFrame) -> DataFrame:
    """One nested row for each inspection: decision and reason, fields, numbered violations with their legal references,
    evidence, notes on declarations of low confidence, and the seal.

    references: rule_version_id, title, legal_reference. Verdicts are gathered by inspection once, and the decision,
    fields, violations and evidence all follow from that one array; decisions that don't rest on verdicts have none.
    """
    fields = co.field_columns()
    shown = F.when((fields["status"] == "PASS") & (F.coalesce(fields["field_confidence"], F.lit(0.0)) < LOW_CONFIDENCE), "LOW_CONF").otherwise(fields["status"])
    severity = F.upper(co.severity(F.col("field_type"), F.col("verdict_type")))
    one = F.struct("rule_version_id", fields["field_type"].alias("field_type"), shown.alias("status"), "verdict", severity.alias("severity"), "detail", "title", "legal_reference", co.is_low().alias("low"))
    gathered = verdicts.join(small(references), "rule_version_id", "left").groupBy("inspection_id").agg(F.array_sort(F.collect_list(one)).alias("vs"))
    rows = inspections.select(F.col("id").alias("inspection_id")).join(gathered, "inspection_id", "left").join(declaration_facts(declarations), "inspection_id", "left").join(co.latest_images(images), "inspection_id", "left")
    rows = rows.withColumn("n_extracted", F.coalesce("n_extracted", F.lit(0)))
    some = lambda test: F.filter(F.coalesce("vs", F.array()), test)
    counts = {"n_pass": some(lambda x: x["verdict"] == "PASS"), "n_fail": some(lambda x: x["verdict"] == "FAIL"), "n_low": some(lambda x: x["low"])}
    rows = rows.withColumns({name: F.size(c) for name, c in counts.items()})
    status, reason = co.overall(F.col("n_extracted"), F.col("n_pass"), F.col("n_fail"), F.col("n_low"))
    rows = rows.withColumn("compliance_status", status).withColumn("status_reason", reason)
    rows = rows.withColumn("vs", F.when(~F.col("compliance_status").isin(*co.HELD), F.col("vs")))
    told = lambda x, i: F.struct((i + 1).alias("number"), *(x[c].alias(c) for c in ("rule_version_id", "field_type", "severity", "detail", "title", "legal_reference")))
    rows = rows.withColumn("violations", F.transform(some(lambda x: x["verdict"] == "FAIL"), told))
    images_of = F.when(F.col("image_id").isNull(), F.array()).otherwise(F.transform("violations", lambda x: F.struct(x["rule_version_id"].alias("rule_version_id"), F.col("image_id").alias("image_id"))))
    return rows.select(
        F.sha2(F.concat(F.lit("report~"), "inspection_id"), 256).alias("report_id"), "inspection_id", "compliance_status", "status_reason", (F.col("compliance_status") == "COMPLIANT").alias("seal"),
        F.transform(F.coalesce("vs", F.array()), lambda x: F.struct(*(x[c].alias(c) for c in ("rule_version_id", "field_type", "status")))).alias("declarations"), "violations",
        F.array_sort(F.array_distinct(F.filter(F.transform("violations", lambda x: x["legal_reference"]), lambda x: x.isNotNull()))).alias("legal_references"), images_of.alias("evidence"), F.coalesce("notes", F.array()).alias("notes"),
    )


def export_json(facts: DataFrame, path: str, generated_at: str) -> None:
    """Reports as JSON lines."""
    facts.withColumn("generated_at", F.lit(generated_at)).write.mode("overwrite").json(path)


def due_reports(schedule: DataFrame, now: str) -> DataFrame:
    """Scheduled reports whose time has come are done now; the others stay."""
    at = F.lit(now).cast("timestamp")
    due = (F.col("status") == "scheduled") & (F.col("scheduled_time") <= at)
    return schedule.withColumn("new_status", F.when(due, "done").otherwise(F.col("status"))).withColumn("processed_at", F.when(due, at))
