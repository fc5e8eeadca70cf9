"""The entities of the data model, and typed scans of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"
CONTENT = (
    "struct<applies_when:struct<product_categories:array<string>,exclude_categories:array<string>,package_type:string>,required_field:string,"
    "validation:struct<type:string,field:string,pattern:string,case_insensitive:boolean,must_contain:array<string>>,severity:string,evidence_required:boolean>"
)
SCHEMAS = {
    "users": "id string, email string, full_name string, role string, region string, is_active boolean, created_at timestamp",
    "categories": "id string, name string, parent_id string",
    "products": "id string, barcode string, product_name string, category_id string, manufacturer_name string, previous_inspection_id string, created_at timestamp",
    "inspections": "id string, product_id string, inspector_id string, status string, location string, region string, source string, overall_status string, created_at timestamp, submitted_at timestamp",
    "images": "id string, inspection_id string, storage_url string, content_hash string, quality_score double, quality_issues array<string>, uploaded_at timestamp",
    "ocr_results": "id string, image_id string, seq int, raw_text string, bbox array<array<int>>, confidence double, language string, created_at timestamp",
    "declarations": f"id string, inspection_id string, field_type string, value struct<text:string>, bbox {BOX}, confidence double, language string, source_ocr_result_id string, created_at timestamp",
    "rules": "id string, rule_key string, title string",
    "rule_versions": "id string, rule_id string, version int, content string, legal_reference string, effective_date date, end_date date, published_by string, published_at timestamp",
    "compliance_checks": "id string, inspection_id string, rule_version_id string, declaration_id string, verdict string, confidence double, evaluated_at timestamp",
    "violations": "id string, inspection_id string, compliance_check_id string, field string, severity string, issue_description string, detected_value string, expected_condition string, created_at timestamp",
    "evidence": f"id string, violation_id string, image_id string, bbox {BOX}, crop_storage_url string, created_at timestamp",
    "corrections": "id string, declaration_id string, compliance_check_id string, corrected_by string, original_value string, corrected_value string, reason string, created_at timestamp",
    "reports": "id string, inspection_id string, pdf_storage_url string, editable_export_url string, generated_at timestamp, generated_by string",
    "audit_logs": "id string, actor_id string, action string, entity_type string, entity_id string, before_value string, after_value string, reason string, created_at timestamp",
}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A typed scan of one entity's Parquet table."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")
