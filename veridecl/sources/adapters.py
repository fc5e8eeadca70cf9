"""Views of the driver's tables as this engine's entities, and the same views as SQL text for DuckDB."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_SCHEMA = (
    "rule_version_id string, rule_key string, version int, effective_date date, end_date date, is_published boolean, product_categories array<string>, "
    "exclude_categories array<string>, package_type string, validation_type string, field string, pattern string, must_contain array<string>"
)
_ALL, _BULK = ["ALL"], ["Industrial/Bulk"]
RULES = [
    ("rv01", "MRP-FORMAT", 1, "2020-01-01", "2023-01-01", True, _ALL, _BULK, "retail", "regex_and_presence", "mrp", r"Rs\.\s*\d+", None),
    ("rv02", "MRP-FORMAT", 2, "2023-01-01", None, True, _ALL, _BULK, "retail", "regex_and_presence", "mrp", r"Rs\.\s*\d+", ["inclusive of all taxes"]),
    ("rv03", "NET-QUANTITY", 1, "2020-01-01", None, True, _ALL, None, "retail", "presence_only", "net_quantity", None, None),
    ("rv04", "MANUFACTURER", 1, "2020-01-01", None, True, None, None, None, "presence_only", "manufacturer_name", None, None),
    ("rv05", "DATE", 1, "2021-06-01", None, True, ["Food & Beverage"], None, "retail", "presence_only", "mfg_date", None, None),
    ("rv06", "CARE", 1, "2022-01-01", "2024-07-01", True, ["Household > Home Care"], None, None, "format_check", "consumer_care", r"^v\d*[02468]$", None),
    ("rv07", "ORIGIN", 1, "2024-07-01", None, False, ["Cosmetics"], None, None, "presence_only", "country_of_origin", None, None),
    ("rv08", "FUTURE", 1, "2030-01-01", None, True, _ALL, None, None, "presence_only", "mrp", None, None),
    ("rv09", "UNKNOWN-TYPE", 1, "2025-01-01", None, True, _ALL, None, None, "numeric_range", "mrp", None, None),
    ("rv10", "NO-VALIDATION", 1, "2025-01-01", None, True, _ALL, None, None, None, None, None, None),
]

#: Text that both dialects take; {..} are tables.
COMMON = {
    "products_v": """SELECT CAST(p_partkey AS STRING) id, p_name product_name,
 CASE p_type WHEN 'ECONOMY' THEN 'Food & Beverage > Packaged Food' WHEN 'SMALL' THEN 'Food & Beverage > Beverages'
  WHEN 'MEDIUM' THEN 'Household > Home Care' WHEN 'PROMO' THEN 'Personal Care & Cosmetics > Cosmetics'
  WHEN 'LARGE' THEN 'Industrial/Bulk' ELSE NULL END category, p_brand manufacturer_name FROM {part}""",
    "inspections_v": """SELECT CAST(o.o_orderkey AS STRING) id, CAST(o.o_orderkey % (SELECT count(*) FROM {part}) AS STRING) product_id,
 CAST(o.o_custkey % 40 AS STRING) inspector_id, r.r_name region, CASE WHEN o.o_orderkey % 5 = 0 THEN 'ecommerce' ELSE 'physical' END source,
 CASE WHEN o.o_orderkey % 11 = 0 THEN 'FLAGGED_FOR_REVIEW' WHEN o.o_orderstatus='F' THEN 'COMPLIANT' WHEN o.o_orderstatus='O' THEN 'NON_COMPLIANT'
  WHEN o.o_orderkey % 3 = 0 THEN 'NEEDS_HUMAN_REVIEW' WHEN o.o_orderkey % 3 = 1 THEN 'PARTIALLY_COMPLIANT' ELSE 'INSUFFICIENT_EVIDENCE' END overall_status,
 CASE WHEN o.o_orderpriority='1-URGENT' THEN 'wholesale' WHEN o.o_orderpriority='2-HIGH' THEN NULL ELSE 'retail' END package_type,
 o.o_orderdate + INTERVAL 9131 DAY created_at
 FROM {orders} o LEFT JOIN {customer} c ON o.o_custkey=c.c_custkey LEFT JOIN {nation} n ON c.c_nationkey=n.n_nationkey LEFT JOIN {region} r ON n.n_regionkey=r.r_regionkey""",
    "declarations_v": """SELECT CAST(l_orderkey AS STRING) inspection_id, CAST(l_linenumber AS BIGINT)*10000000000 + l_partkey*10000 + l_suppkey AS ord,
 CASE l_partkey % 7 WHEN 0 THEN 'mrp' WHEN 1 THEN 'net_quantity' WHEN 2 THEN 'manufacturer_name' WHEN 3 THEN 'mfg_date' WHEN 4 THEN 'consumer_care' WHEN 5 THEN 'country_of_origin' ELSE 'product_name' END field_type,
 CASE WHEN l_returnflag='R' AND l_linestatus='O' THEN NULL WHEN l_partkey % 7 = 0 AND l_suppkey % 2 = 0 THEN 'MRP Rs. '||CAST(CAST(l_quantity AS INT) AS STRING)||' inclusive of all taxes'
  WHEN l_partkey % 7 = 0 THEN 'Rs. '||CAST(CAST(l_quantity AS INT) AS STRING) ELSE 'v'||CAST(l_suppkey AS STRING) END text,
 round(1.0 - l_discount*9, 6) confidence FROM {lineitem}""",
    "checks_v": """SELECT CAST(l_orderkey AS STRING)||'-'||CAST(l_linenumber AS STRING)||'-'||CAST(l_partkey AS STRING)||'-'||CAST(l_suppkey AS STRING) id, CAST(l_orderkey AS STRING) inspection_id,
 CAST(l_linenumber AS BIGINT)*10000000000 + l_partkey*10000 + l_suppkey AS ord,
 CASE l_partkey % 7 WHEN 0 THEN 'mrp' WHEN 1 THEN 'net_quantity' WHEN 2 THEN 'manufacturer_name' WHEN 3 THEN 'mfg_date' WHEN 4 THEN 'consumer_care' WHEN 5 THEN 'country_of_origin' ELSE NULL END field_type,
 CASE WHEN l_returnflag='A' THEN 'pass' WHEN l_returnflag='R' THEN 'fail' WHEN l_linestatus='O' THEN 'needs_review' ELSE 'not_applicable' END verdict,
 CASE WHEN l_returnflag='N' AND l_linestatus='F' THEN NULL ELSE round(1.0 - l_discount*9, 6) END confidence FROM {lineitem}""",
    "boxes_v": """SELECT l_orderkey image_id, CAST(l_linenumber AS BIGINT)*10000000000 + l_partkey*10000 + l_suppkey AS seq, CASE WHEN l_linestatus='O' THEN 'package' ELSE 'label' END class_name,
 CAST(l_partkey % 60 AS INT) x1, CAST(l_suppkey % 40 AS INT) y1, CAST(l_partkey % 60 + 20 + l_quantity AS INT) x2, CAST(l_suppkey % 40 + 20 + l_quantity AS INT) y2, round(1.0 - l_discount*9, 6) confidence FROM {lineitem}""",
    "requests_v": """SELECT event_id, ts, CAST(user_id AS STRING) actor_id, CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'PATCH' WHEN 'signup' THEN 'POST' WHEN 'purchase' THEN 'PUT' ELSE 'DELETE' END AS method,
 CASE event_id % 6 WHEN 0 THEN '/api/v1/inspections/'||CAST(user_id AS STRING) WHEN 1 THEN '/api/v1/inspections/'||CAST(user_id AS STRING)||'/images' WHEN 2 THEN '/api/v1/rules/'||CAST(user_id AS STRING) WHEN 3 THEN '/health' WHEN 4 THEN '/api/v1/auth/login' ELSE '/api/v1/corrections/'||CAST(user_id AS STRING) END path FROM {events}""",
    "images_v": """SELECT doc_id id, CAST(doc_id AS STRING) inspection_id, {sha} content_hash, n_chars, {at} uploaded_at FROM {documents}""",
    "ocr_tokens_v": """SELECT CAST(d.doc_id AS STRING) inspection_id, s.seq, CASE s.seq
 WHEN 0 THEN 'Good Day Biscuits '||d.source
 WHEN 1 THEN CASE d.doc_id % 5 WHEN 0 THEN 'MRP ₹' WHEN 1 THEN 'Rs. ' WHEN 2 THEN '₹' WHEN 3 THEN 'MRP Rs. ' ELSE 'INR ' END || CAST(d.doc_id % 900 + 10 AS STRING)
 WHEN 2 THEN CASE d.doc_id % 4 WHEN 0 THEN 'Net 500gm' WHEN 1 THEN '1.5kg' WHEN 2 THEN '330ml' ELSE 'Contents' END
 WHEN 3 THEN CASE d.doc_id % 5 WHEN 0 THEN 'MFG 08/2026' WHEN 1 THEN 'PKD 12-2025' WHEN 2 THEN 'imp 15/08/2026' WHEN 3 THEN 'MFG 13/2026' ELSE '' END
 WHEN 4 THEN CASE WHEN d.doc_id % 3 = 0 THEN 'Manufactured by ABC Industries, Pune' WHEN d.doc_id % 3 = 1 THEN 'Mfr: Sunrise Agro. Delhi' ELSE 'Premium quality' END
 WHEN 5 THEN CASE WHEN d.doc_id % 2 = 0 THEN 'Consumer Care: 1800-123-4567' ELSE 'Best before 6 months' END
 ELSE CASE d.doc_id % 4 WHEN 0 THEN 'Country of Origin: India' WHEN 1 THEN 'Made in Nepal' WHEN 2 THEN 'भारत 2kg' ELSE 'Net 2kg' END END AS text,
 CAST(0.40 + ((d.doc_id*7 + s.seq*13) % 60)/100.0 AS DOUBLE) confidence
 FROM {documents} d {seqs}""",
}
_TABLES = ("part", "orders", "customer", "nation", "region", "lineitem", "events", "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, **instead: DataFrame) -> DataFrame:
    """One adapter view as a DataFrame; timestamps are TIMESTAMP in the session's zone. ``instead``: rows that are taken for
    those of the table so named."""
    if name == "rules_v":
        day = lambda x: x and dt.date.fromisoformat(x)
        return spark.createDataFrame([(*r[:3], day(r[3]), day(r[4]), *r[5:]) for r in RULES], RULE_SCHEMA)
    used = {t: instead[t] if t in instead else table(spark, sf_dir, t) for t in _TABLES if f"{{{t}}}" in COMMON[name]}
    text = COMMON[name].replace("{sha}", "sha2(text, 256)").replace("{at}", "timestampadd(SECOND, doc_id, TIMESTAMP_NTZ '2024-01-01 00:00:00')").replace("{seqs}", "LATERAL VIEW explode(sequence(0, 6)) s AS seq")
    df = spark.sql(text, **used)
    for column, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(column, F.col(column).cast("timestamp"))
    if name == "ocr_tokens_v":
        # all that is done with tokens groups them by inspection, and a small file would be one task's work
        df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "inspection_id")
    return df


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "TRUE" if x else "FALSE"
    if isinstance(x, list):
        return "[" + ",".join(map(_literal, x)) + "]"
    return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def with_views(*names: str) -> str:
    """A WITH clause of adapter views in DuckDB's dialect, over the driver's tables."""
    parts = []
    for name in names:
        if name == "rules_v":
            rows = ",\n ".join(f"({', '.join(_literal(x) for x in r)})" for r in RULES)
            columns = ",".join(c.split()[0] for c in RULE_SCHEMA.split(", "))
            text = f"SELECT rule_version_id, rule_key, version, CAST(effective_date AS DATE) effective_date, CAST(end_date AS DATE) end_date, is_published, product_categories, exclude_categories, package_type, validation_type, field, pattern, must_contain FROM (VALUES\n {rows}) t({columns})"
        else:
            text = COMMON[name].replace("{sha}", "sha256(text)").replace("{at}", "TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(doc_id AS BIGINT))").replace("{seqs}", "CROSS JOIN (SELECT unnest([0,1,2,3,4,5,6]) seq) s")
            for t in _TABLES:
                text = text.replace(f"{{{t}}}", t)
        parts.append(f"{name} AS (\n{text})")
    return "WITH " + ",\n".join(parts)
