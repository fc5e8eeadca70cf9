"""Queries that write files and read them again: all entities, annotations by image, and encoded images."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import inspections as ins
from ..sources import checks, files, schemas
from ..sources.adapters import view
from .geometry_queries import BOXES, boxes
from .registry import query
from .stream_queries import folder

#: Columns of all entities over the given tables, in words that both dialects take; some keys have no row on purpose.
ENTITIES = {
    "users": "SELECT CAST(n_nationkey AS STRING) id, n_name full_name, CASE n_nationkey % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'clerk' ELSE 'inspector' END AS role FROM {nation}",
    "categories": "SELECT CAST(n_nationkey AS STRING) id, n_name name, CAST(n_nationkey % 7 + 20 AS STRING) parent_id FROM {nation}",
    "products": "SELECT CAST(p_partkey AS STRING) id, p_name product_name, CAST(p_partkey % 30 AS STRING) category_id, CAST(p_partkey * 2 AS STRING) previous_inspection_id FROM {part}",
    "inspections": "SELECT CAST(o_orderkey AS STRING) id, CAST(o_orderkey % 900 AS STRING) product_id, CAST(o_custkey % 40 AS STRING) inspector_id, CASE o_orderkey % 11 WHEN 0 THEN 'FLAGGED_FOR_REVIEW' WHEN 1 THEN 'COMPLIANT' END overall_status FROM {orders}",
    "images": "SELECT CAST(doc_id AS STRING) id, CAST(doc_id * 17 AS STRING) inspection_id FROM {documents}",
    "ocr_results": "SELECT CAST(doc_id AS STRING) id, CAST(doc_id + 5 AS STRING) image_id FROM {documents} WHERE doc_id % 3 = 0",
    "declarations": "SELECT CAST(l_orderkey * 10 + l_linenumber AS STRING) id, CAST(l_orderkey AS STRING) inspection_id, CASE WHEN l_linenumber = 1 THEN CAST(l_orderkey AS STRING) END source_ocr_result_id FROM {lineitem}",
    "rules": "SELECT CASE WHEN s_suppkey % 9 <> 4 THEN CAST(s_suppkey AS STRING) END id, s_name rule_key FROM {supplier}",
    "rule_versions": "SELECT CAST(c_custkey AS STRING) id, CAST(c_custkey % 50 AS STRING) rule_id, CAST(c_nationkey + 2 AS STRING) published_by FROM {customer}",
    "compliance_checks": "SELECT CAST(l_orderkey * 10 + l_linenumber AS STRING) id, CAST(l_orderkey AS STRING) inspection_id, CAST(l_partkey AS STRING) rule_version_id, CAST(l_orderkey * 10 + 2 AS STRING) declaration_id, CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'R' THEN 'fail' ELSE 'unknown' END verdict FROM {lineitem}",
    "violations": "SELECT CAST(l_orderkey * 10 + l_linenumber AS STRING) id, CAST(l_orderkey AS STRING) inspection_id, CAST(l_orderkey * 10 + l_linenumber AS STRING) compliance_check_id, CASE WHEN l_quantity > 40 THEN 'high' WHEN l_quantity > 20 THEN 'major' END severity FROM {lineitem} WHERE l_returnflag = 'R'",
    "evidence": "SELECT CAST(l_orderkey * 10 + l_linenumber AS STRING) id, CAST(l_orderkey * 10 + l_linenumber AS STRING) violation_id, CAST(l_orderkey AS STRING) image_id FROM {lineitem} WHERE l_linestatus = 'F'",
    "corrections": "SELECT CAST(l_orderkey * 10 + l_linenumber AS STRING) id, CAST(l_orderkey * 10 + l_linenumber AS STRING) declaration_id, CAST(l_orderkey * 10 + l_linenumber + 1 AS STRING) compliance_check_id, CAST(l_suppkey AS STRING) corrected_by FROM {lineitem} WHERE l_quantity < 5",
    "reports": "SELECT CAST(o_orderkey AS STRING) id, CAST(o_orderkey + 1 AS STRING) inspection_id, CAST(o_custkey AS STRING) generated_by FROM {orders}",
    "audit_logs": "SELECT CAST(event_id AS STRING) id, CAST(user_id AS STRING) actor_id, event_type action FROM {events}",
}
#: A column too many, one too few, and one of another type.
EXTRA, LACKING, RETYPED = ("images", "camera"), ("reports", "generated_at"), ("ocr_results", "seq")


def _issues() -> str:
    parts = [f"SELECT '{e}' AS entity, '{issue}' AS issue, '{c}' AS field, 1 AS n" for (e, c), issue in ((EXTRA, "unknown_column"), (LACKING, "missing_column"), (RETYPED, "type"))]
    for name in ENTITIES:
        parts.append(f"SELECT '{name}', 'null_key', 'id', count(*) FILTER (WHERE id IS NULL) FROM e_{name}")
        parts.append(f"SELECT '{name}', 'duplicate_key', 'id', count(*) FROM (SELECT id FROM e_{name} WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)")
    for (name, column), allowed in checks.VALUES.items():
        parts.append(f"SELECT '{name}', 'bad_value', '{column}', count(*) FROM e_{name} WHERE {column} NOT IN ({', '.join(repr(v) for v in allowed)})")
    for (name, column), other in checks.REFERENCES.items():
        parts.append(f"SELECT '{name}', 'orphan', '{column}', count(*) FROM e_{name} x WHERE {column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e_{other} y WHERE y.id = x.{column})" if re.search(rf"\b{column}\b", ENTITIES[name]) else f"SELECT '{name}', 'orphan', '{column}', 0")
    views = ", ".join(f"e_{name} AS ({re.sub(r'[{}]', '', text)})" for name, text in ENTITIES.items())
    return f"WITH {views} SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE n > 0"


@query(_issues())
def a1_check_entities(spark, sf):
    """All 15 entities written over the given tables, with a column too many, one too few and one of another type, and
    scanned for what is wrong with them."""
    path = f"{folder(spark)}/entities-{uuid.uuid4().hex}"
    for name, text in ENTITIES.items():
        rows = spark.sql(text, **{t: spark.read.parquet(f"{sf}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", text))})
        want = [(f.name, f.dataType) for f in StructType.fromDDL(schemas.SCHEMAS[name])]
        columns = [(F.col(c) if c in rows.columns else F.lit(None)).cast("double" if (name, c) == RETYPED else kind).alias(c) for c, kind in want if (name, c) != LACKING]
        rows.select(*columns, *([F.lit("x").alias(EXTRA[1])] if name == EXTRA[0] else [])).write.parquet(f"{path}/{name}.parquet")
    return checks.check_entities(spark, path)


@query(BOXES + "SELECT CAST(seq % 10000 AS VARCHAR) AS image_id, CASE class_name WHEN 'package' THEN 0 ELSE 1 END AS cls, x1, y1, x2, y2, count(*) AS n FROM boxes_v GROUP BY ALL")
def a5_label_files(spark, sf):
    """Annotation files, one for each of the suppliers that are taken for images, written and read again."""
    path = f"{folder(spark)}/labels-{uuid.uuid4().hex}"
    rows = boxes(spark, sf).withColumn("image_id", F.col("seq") % 10000).withColumn("width", F.lit(120)).withColumn("height", F.lit(100))
    files.write_yolo_labels(rows, path)
    dims = rows.select("image_id", "width", "height").distinct()
    return files.read_yolo_labels(spark, path, dims).groupBy("image_id", "cls", "x1", "y1", "x2", "y2").agg(F.count("*").alias("n"))


#: Pixels of the images that are written: so many a side, each from the documents of a source with one remainder.
SIDE = 16
_PIXELS = f"""WITH v AS (SELECT source, k, coalesce(s, 0) % 256 AS v FROM (SELECT DISTINCT source FROM documents) CROSS JOIN (SELECT unnest(range({SIDE * SIDE})) AS k) LEFT JOIN (SELECT source, doc_id % {SIDE * SIDE} AS k, CAST(sum(n_chars) AS BIGINT) AS s FROM documents GROUP BY 1, 2) USING (source, k)),
p AS (SELECT source, k % {SIDE} AS x, k // {SIDE} AS y, v FROM v),
l AS (SELECT p.source, p.v, a.v + b.v + c.v + d.v - 4 * p.v AS l FROM p
 JOIN p a ON a.source = p.source AND a.y = p.y AND a.x = abs(p.x - 1) JOIN p b ON b.source = p.source AND b.y = p.y AND b.x = {SIDE - 1} - abs({SIDE - 1} - p.x - 1)
 JOIN p c ON c.source = p.source AND c.x = p.x AND c.y = abs(p.y - 1) JOIN p d ON d.source = p.source AND d.x = p.x AND d.y = {SIDE - 1} - abs({SIDE - 1} - p.y - 1))
SELECT source AS image_id, {SIDE} AS width, {SIDE} AS height, avg(l * l) - avg(l) * avg(l) AS laplacian_variance, avg(CAST(v >= 240 AS INT)) AS bright_ratio, avg(CAST(v <= 15 AS INT)) AS dark_ratio FROM l GROUP BY 1"""


@query(_PIXELS)
def a9_read_images(spark, sf):
    """Encoded images, one for each source of documents, and files that are none, written and read again: pixel metrics."""
    path = f"{folder(spark)}/images-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sums = docs.groupBy("source", (F.col("doc_id") % (SIDE * SIDE)).alias("k")).agg((F.sum("n_chars") % 256).alias("v"))
    # a source has a value for each pixel at most
    values = sums.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    grey = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(SIDE * SIDE - 1).cast("long")), lambda k: F.lpad(F.hex(F.coalesce(F.try_element_at("m", k), F.lit(0))), 2, "0"))
    images = values.select(F.col("source").alias("image_id"), files.encode_bmp(F.unhex(F.array_join(grey, "")), F.lit(SIDE), F.lit(SIDE)).alias("content"))
    broken = images.select(F.concat("image_id", F.lit("-broken")).alias("image_id"), F.lit("no image").cast("binary").alias("content"))
    files.write_images(images.unionByName(broken), path)
    out = ins.pixel_metrics(files.read_images(spark, path)).withColumn("image_id", files.image_id(F.col("origin")))
    # sums of 256 small whole numbers: exact in both, so nothing is rounded
    return out.select("image_id", "width", "height", "laplacian_variance", "bright_ratio", "dark_ratio")
