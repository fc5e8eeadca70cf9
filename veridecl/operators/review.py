"""Human review: the queue, corrections and the gate before submission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import valid_reason

REVIEW_BELOW = 0.7


def _queued() -> Column:
    return (F.col("verdict") == "needs_review") | F.coalesce(F.col("confidence") < REVIEW_BELOW, F.lit(False))


def review_items(checks: DataFrame, declarations: DataFrame | None = None) -> DataFrame:
    """Checks that need a person: so judged, or of low confidence; without a declaration the field is unknown.

    With declarations (declaration_id, field_type, text), the field and value are those of the check's declaration_id.
    """
    status = F.when(F.col("verdict") == "pass", "confirmed").otherwise("pending")
    rows, value = checks.filter(_queued()), []
    if declarations is not None:
        said = declarations.select("declaration_id", F.col("field_type").alias("said_field"), F.col("text").alias("value"))
        rows = rows.join(said, "declaration_id", "left").withColumn("field_type", F.col("said_field"))
        value = ["value"]
    return rows.select("id", "inspection_id", F.coalesce("field_type", F.lit("unknown")).alias("field_type"), "verdict", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), status.alias("status"), "ord", *value)


def review_queue(checks: DataFrame, status: str, inspections: DataFrame | None = None, region: str | None = None) -> DataFrame:
    """Items of one status, with how many there are and how many are pending in all; of one region's inspections
    (id, region) only, if one is named."""
    items = review_items(checks)
    if region is not None:
        items = items.join(inspections.filter(F.col("region") == region).select(F.col("id").alias("inspection_id")), "inspection_id", "left_semi")
    totals = items.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "pending").alias("pending"))  # one row
    return items.filter(F.col("status") == status).crossJoin(F.broadcast(totals))


def queue_summary(checks: DataFrame) -> DataFrame:
    rows = review_items(checks).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "confirmed").alias("confirmed"))
    return rows.withColumn("pending_ratio", F.when(F.col("total") > 0, F.round(F.col("pending") / F.col("total"), 4)).otherwise(0.0))


def apply_reviews(checks: DataFrame, events: DataFrame) -> DataFrame:
    """Checks after the reviews (check_id, kind, reason, created_at): one with a valid event passes at confidence 1."""
    good = events.filter((F.col("kind") == "confirm") | valid_reason(F.col("reason"))).groupBy(F.col("check_id").alias("id")).agg(F.max_by("kind", F.struct("created_at", "kind")).alias("kind"))
    rows = checks.join(good, "id", "left")
    done = F.col("kind").isNotNull()
    return rows.select("id", "inspection_id", F.col("verdict").alias("verdict_before"), F.when(done, "pass").otherwise(F.col("verdict")).alias("verdict"), F.when(done, 1.0).otherwise(F.col("confidence")).alias("confidence"), F.coalesce("kind", F.lit("none")).alias("review"))


def rejected_reviews(events: DataFrame) -> DataFrame:
    """Corrections whose reason is too short."""
    return events.filter((F.col("kind") != "confirm") & ~valid_reason(F.col("reason")))


def correction_rows(events: DataFrame, checks: DataFrame) -> DataFrame:
    """Valid corrections with what was there before, as JSON."""
    rows = events.filter((F.col("kind") != "confirm") & valid_reason(F.col("reason"))).join(checks.select(F.col("id").alias("check_id"), "field_type", "verdict", "confidence"), "check_id", "left")
    return rows.select("check_id", F.to_json(F.struct("field_type", "verdict")).alias("original_value"), "confidence", "corrected_value", "reason")


def can_submit(inspections: DataFrame, checks: DataFrame) -> DataFrame:
    """Whether each inspection may be reported: not while a check needs review; the reason names the fields."""
    open_ = checks.filter("verdict = 'needs_review'").groupBy("inspection_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.coalesce("field_type", F.lit("unknown")))), ", ").alias("fields"))
    rows = inspections.select(F.col("id").alias("inspection_id")).join(open_, "inspection_id", "left")
    reason = F.when(F.col("n").isNotNull(), F.format_string("%d field(s) pending review: %s", "n", "fields")).otherwise("")
    return rows.select("inspection_id", F.col("n").isNull().alias("can_submit"), reason.alias("reason"))


def first_pending(checks: DataFrame) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("inspection_id").orderBy("ord", "id"))
    return review_items(checks).filter("status = 'pending'").withColumn("rn", rank).filter("rn = 1").select("inspection_id", "id", "field_type")
