"""From verdicts to decisions, violations, checks and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAST_FIELDS, LEAST_CONFIDENCE = 3, 0.5
# Fields whose absence is critical, and fields whose format is major.
CRITICAL_FIELDS = ["mrp", "manufacturer_name", "net_quantity", "mfg_date", "country_of_origin"]
MAJOR_FORMATS = ["mrp", "mfg_date", "pkd_date"]
#: Decisions that don't rest on verdicts: no field rows or violations follow from them.
HELD = ("INSUFFICIENT_EVIDENCE", "NEEDS_HUMAN_REVIEW")
# The status that an inspection takes from its decision.
STATUS_MAP = {"COMPLIANT": "approved", "NON_COMPLIANT": "flagged", "PARTIALLY_COMPLIANT": "flagged", "NEEDS_HUMAN_REVIEW": "pending_review", "INSUFFICIENT_EVIDENCE": "insufficient"}


def severity(field: Column, verdict_type: Column) -> Column:
    field = F.lower(F.coalesce(field, F.lit("")))
    return F.when(verdict_type == "MISSING", F.when(field.isin(*CRITICAL_FIELDS), "critical").otherwise("major")).when((verdict_type == "FORMAT") & field.isin(*MAJOR_FORMATS), "major").otherwise("minor")


def count_extracted(declarations: DataFrame) -> DataFrame:
    """Per inspection how many declarations have a text (blanks count), and the fields that have none."""
    none = F.array_join(F.array_sort(F.collect_set(F.when(F.col("text").isNull(), F.col("field_type")))), ",")
    return declarations.groupBy("inspection_id").agg(F.count_if(F.length("text") > 0).alias("n_extracted"), none.alias("empty_fields"))


def insufficient_evidence(inspections: DataFrame, declarations: DataFrame, least: int = LEAST_FIELDS) -> DataFrame:
    """Inspections with fewer than ``least`` extracted fields."""
    rows = inspections.select(F.col("id").alias("inspection_id")).join(count_extracted(declarations), "inspection_id", "left").fillna({"n_extracted": 0, "empty_fields": ""})
    return rows.filter(F.col("n_extracted") < least)


def _field() -> Column:
    return F.coalesce(F.nullif(F.col("field_type"), F.lit("")), F.col("rule_key"))


def is_low(threshold: float = LEAST_CONFIDENCE) -> Column:
    return (F.col("verdict") != "PASS") & (F.col("verdict_type") != "MISSING") & (F.coalesce("confidence", F.lit(1.0)) < threshold)


def low_confidence_fields(verdicts: DataFrame, threshold: float = LEAST_CONFIDENCE) -> DataFrame:
    """Per inspection the fields whose verdict is no pass, not for absence, and of low confidence."""
    rows = verdicts.filter(is_low(threshold)).groupBy("inspection_id").agg(F.array_sort(F.collect_list(F.struct("rule_order", _field().alias("f")))).alias("l"))
    return rows.select("inspection_id", F.array_join(F.transform("l", lambda x: x["f"]), ", ").alias("fields"), F.size("l").alias("n"))


def field_columns() -> dict[str, Column]:
    """Of a verdict the field that it is about, its status and its confidence."""
    known = F.col("verdict").isin("PASS", "FAIL", "NOT_APPLICABLE")
    confidence = F.when(F.col("verdict") == "PASS", 1.0).when(F.col("verdict") == "FAIL", F.when(F.col("verdict_type") == "MISSING", 0.0).otherwise(1.0))
    return {"field_type": _field(), "status": F.when(known, F.col("verdict")).otherwise("NEEDS_REVIEW"), "field_confidence": confidence}


def field_compliance(verdicts: DataFrame) -> DataFrame:
    own = [c.alias(name) for name, c in field_columns().items()]
    return verdicts.select("inspection_id", "rule_version_id", "rule_key", *own, "detail")


def violations(verdicts: DataFrame) -> DataFrame:
    """A row for each FAIL."""
    return verdicts.filter("verdict = 'FAIL'").select("inspection_id", "rule_version_id", "rule_key", _field().alias("field"), severity(F.col("field_type"), F.col("verdict_type")).alias("severity"), F.col("detail").alias("issue_description"), F.col("text").alias("detected_value"))


def decide(passed: Column, failed: Column) -> tuple[Column, Column]:
    """Status and reason from the numbers of passed and failed rules."""
    status = F.when((failed == 0) & (passed > 0), "COMPLIANT").when((failed > 0) & (passed == 0), "NON_COMPLIANT").when(failed > 0, "PARTIALLY_COMPLIANT").otherwise("COMPLIANT")
    reason = (
        F.when((failed == 0) & (passed > 0), F.format_string("All %d applicable rule(s) passed.", passed))
        .when((failed > 0) & (passed == 0), F.format_string("All %d applicable rule(s) failed.", failed))
        .when(failed > 0, F.format_string("%d rule(s) passed, %d rule(s) failed.", passed, failed))
        .otherwise("No applicable rules found for this product category and date.")
    )
    return status, reason


def overall(extracted: Column, passed: Column, failed: Column, low: Column, least: int = LEAST_FIELDS) -> tuple[Column, Column]:
    """Status and reason of an inspection: too little evidence goes before doubtful fields, these before the verdicts."""
    status, reason = decide(passed, failed)
    few, doubt = extracted < least, low > 0
    status = F.when(few, "INSUFFICIENT_EVIDENCE").when(doubt, "NEEDS_HUMAN_REVIEW").otherwise(status)
    reason = F.when(few, F.format_string("Only %d fields extracted.", extracted)).when(doubt, F.format_string("%d field(s) need review.", low)).otherwise(reason)
    return status, reason


def evaluate_compliance(inspections: DataFrame, verdicts: DataFrame, declarations: DataFrame, least: int = LEAST_FIELDS, threshold: float = LEAST_CONFIDENCE) -> DataFrame:
    """One decision for each inspection: too little evidence goes before doubtful fields, these before the verdicts.

    Verdicts and declarations are each reduced to one row an inspection before they are joined.
    """
    counts = verdicts.groupBy("inspection_id").agg(F.count_if(F.col("verdict") == "PASS").alias("n_pass"), F.count_if(F.col("verdict") == "FAIL").alias("n_fail"), F.count_if(F.col("verdict") == "NOT_APPLICABLE").alias("n_na"), F.count_if(is_low(threshold)).alias("n_low"))
    rows = inspections.select(F.col("id").alias("inspection_id")).join(count_extracted(declarations), "inspection_id", "left").join(counts, "inspection_id", "left").fillna(0, ["n_extracted", "n_pass", "n_fail", "n_na", "n_low"])
    status, reason = overall(F.col("n_extracted"), F.col("n_pass"), F.col("n_fail"), F.col("n_low"), least)
    rested = ~status.isin(*HELD)
    return rows.select("inspection_id", status.alias("overall_status"), reason.alias("status_reason"), "n_extracted", "n_pass", "n_fail", "n_na", F.when(rested, F.col("n_fail")).otherwise(F.lit(0)).alias("n_violations"))


def open_verdicts(verdicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """The verdicts of inspections whose decision rests on them; the others emit no field rows or violations."""
    held = decisions.filter(F.col("overall_status").isin(*HELD)).select("inspection_id")
    return verdicts.join(held, "inspection_id", "left_anti")


def check_id(*parts: str) -> Column:
    """An id that a repeated run makes again."""
    return F.sha2(F.concat_ws("~", *parts), 256)


def compliance_checks(fields: DataFrame) -> DataFrame:
    return fields.select(check_id("inspection_id", "rule_version_id").alias("id"), "inspection_id", "rule_version_id", "field_type", F.lower(F.translate("status", " ", "_")).alias("verdict"), F.col("field_confidence").alias("confidence"))


def violation_rows(found: DataFrame, checks: DataFrame) -> DataFrame:
    """Violations with the check that they belong to."""
    return found.join(checks.select("inspection_id", "rule_version_id", F.col("id").alias("compliance_check_id")), ["inspection_id", "rule_version_id"])


def inspection_status(status: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in STATUS_MAP.items() for x in pair])[status], F.lit("pending"))


def latest_images(images: DataFrame) -> DataFrame:
    return images.groupBy("inspection_id").agg(F.max_by("id", F.struct("uploaded_at", "id")).alias("image_id"))


def evidence(found: DataFrame, images: DataFrame) -> DataFrame:
    """The latest image of an inspection with each of its violations; without an image, none."""
    return found.join(latest_images(images), "inspection_id").select("inspection_id", "rule_version_id", "image_id", check_id("inspection_id", "rule_version_id", "image_id").alias("id"))


def evidence_counts(shown: DataFrame) -> DataFrame:
    return shown.groupBy("inspection_id").agg(F.count("*").alias("n_evidence"))


def outcomes(inspections: DataFrame, verdicts: DataFrame, declarations: DataFrame, images: DataFrame) -> DataFrame:
    """One nested row for each inspection: the decision, the counts that it rests on, and all that follows from it.

    Returns inspection_id, overall_status, status_reason, n_extracted, n_pass, n_fail, n_na, image_id, and arrays by
    rule_version_id: checks (id, rule_version_id, field_type, verdict, confidence), violations (rule_version_id, rule_key,
    field, severity, issue_description, detected_value, compliance_check_id) and evidence (rule_version_id, image_id, id).

    Verdicts are gathered by inspection once, and everything is read off that one array; decisions that don't rest on
    verdicts (HELD) have none of the three. An inspection has as many verdicts as rules apply to it.
    """
    rows = inspections.select(F.col("id").alias("inspection_id")).join(gathered_verdicts(verdicts), "inspection_id", "left").join(count_extracted(declarations), "inspection_id", "left").join(latest_images(images), "inspection_id", "left")
    return concluded(rows)


def gathered_verdicts(verdicts: DataFrame, *also: str) -> DataFrame:
    """One row for each inspection with its verdicts in an array; ``also`` names columns that its rows have alike. Rows
    without a rule give no verdict."""
    own = field_columns()
    one = F.struct("rule_version_id", "rule_key", own["field_type"].alias("field"), own["status"].alias("status"), own["field_confidence"].alias("sure"), "verdict", severity(F.col("field_type"), F.col("verdict_type")).alias("severity"), "detail", "text", is_low().alias("low"))
    one = F.when(F.col("rule_version_id").isNotNull(), one)
    return verdicts.groupBy("inspection_id").agg(F.array_sort(F.collect_list(one)).alias("vs"), *[F.first(c).alias(c) for c in also])


def concluded(rows: DataFrame, *also: str) -> DataFrame:
    """outcomes() of rows (inspection_id, vs, n_extracted, image_id), with the columns that ``also`` names."""
    some = lambda test: F.filter(F.coalesce("vs", F.array()), test)
    counts = {"n_pass": lambda x: x["verdict"] == "PASS", "n_fail": lambda x: x["verdict"] == "FAIL", "n_na": lambda x: x["verdict"] == "NOT_APPLICABLE", "n_low": lambda x: x["low"]}
    rows = rows.withColumns({"n_extracted": F.coalesce("n_extracted", F.lit(0)), **{name: F.size(some(test)) for name, test in counts.items()}})
    status, reason = overall(*map(F.col, ("n_extracted", "n_pass", "n_fail", "n_low")))
    rows = rows.withColumn("overall_status", status).withColumn("status_reason", reason)
    rows = rows.withColumn("vs", F.when(~F.col("overall_status").isin(*HELD), F.col("vs")))
    id_ = lambda *parts: F.sha2(F.concat_ws("~", "inspection_id", *parts), 256)
    check = lambda x: F.struct(id_(x["rule_version_id"]).alias("id"), x["rule_version_id"].alias("rule_version_id"), x["field"].alias("field_type"), F.lower(F.translate(x["status"], " ", "_")).alias("verdict"), x["sure"].alias("confidence"))
    found = lambda x: F.struct(*(x[c].alias(c) for c in ("rule_version_id", "rule_key", "field", "severity")), x["detail"].alias("issue_description"), x["text"].alias("detected_value"), id_(x["rule_version_id"]).alias("compliance_check_id"))
    shown = lambda x: F.struct(x["rule_version_id"].alias("rule_version_id"), F.col("image_id").alias("image_id"), id_(x["rule_version_id"], F.col("image_id").cast("string")).alias("id"))
    failed = some(counts["n_fail"])
    return rows.select(
        "inspection_id", *also, "overall_status", "status_reason", "n_extracted", "n_pass", "n_fail", "n_na", "image_id", F.transform(F.coalesce("vs", F.array()), check).alias("checks"), F.transform(failed, found).alias("violations"),
        F.transform(F.filter(failed, lambda x: F.col("image_id").isNotNull()), shown).alias("evidence"),
    )


def pipeline_warnings(images: DataFrame, least: float = 0.7) -> DataFrame:
    low = F.col("quality_score") < least
    return images.withColumn("warning", F.when(low, F.format_string("Low image quality: %.2f", "quality_score"))).withColumn("pipeline_passed", ~low)
