"""Queries of reviews, the audit log, inspections, images and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as au
from ..operators import dashboard as da
from ..operators import inspections as ins
from ..operators import review as re_
from ..sources.adapters import view, with_views
from .registry import query

CHECKS = with_views("checks_v")
ITEMS = CHECKS + ", it AS (SELECT id, inspection_id, coalesce(field_type, 'unknown') field_type, verdict, coalesce(confidence, 0) confidence, CASE WHEN verdict = 'pass' THEN 'confirmed' ELSE 'pending' END AS status, ord FROM checks_v WHERE verdict = 'needs_review' OR confidence < 0.7) "
INS = with_views("products_v", "inspections_v")
REQ = with_views("requests_v") + """, ev AS (SELECT event_id, actor_id, CASE method WHEN 'POST' THEN CASE WHEN contains(path, '/images') THEN 'upload_image' ELSE 'create' END WHEN 'DELETE' THEN 'delete' ELSE 'update' END AS action,
 CASE split_part(path, '/', 4) WHEN 'inspections' THEN CASE WHEN split_part(path, '/', 6) = 'images' THEN 'image' ELSE 'inspection' END WHEN 'rules' THEN 'rule' WHEN 'corrections' THEN 'correction' ELSE 'unknown' END AS entity_type,
 split_part(path, '/', 5) AS entity_id, '{"method":"' || method || '","path":"' || path || '"}' AS after_value, ts AS created_at FROM requests_v WHERE method <> 'GET' AND path NOT IN ('/health', '/api/v1/auth/login')) """
_EV = "event_id, actor_id, action, entity_type, entity_id"


def checks(spark, sf):
    return view(spark, sf, "checks_v")


def events(spark, sf):
    return au.audit_events(view(spark, sf, "requests_v"))


@query(
    with_views("checks_v", "declarations_v")
    + """, said AS (SELECT concat_ws('-', inspection_id, CAST(ord AS VARCHAR)) AS declaration_id, max(field_type) AS f, max(text) AS value FROM declarations_v WHERE confidence >= 0.3 GROUP BY 1)
SELECT id, inspection_id, coalesce(f, 'unknown') AS field_type, verdict, coalesce(confidence, 0) AS confidence, CASE WHEN verdict = 'pass' THEN 'confirmed' ELSE 'pending' END AS status, value
FROM checks_v LEFT JOIN said ON said.declaration_id = concat_ws('-', inspection_id, CAST(ord AS VARCHAR)) WHERE verdict = 'needs_review' OR confidence < 0.7"""
)
def g1_review_items(spark, sf):
    """Checks with the declaration that they belong to, if it is sure enough to be kept."""
    key = F.concat_ws("-", "inspection_id", F.col("ord").cast("string")).alias("declaration_id")
    said = view(spark, sf, "declarations_v").filter("confidence >= 0.3").groupBy(key).agg(F.max("field_type").alias("field_type"), F.max("text").alias("text"))
    return re_.review_items(checks(spark, sf).withColumn("declaration_id", key), said).drop("ord")


@query(
    with_views("checks_v", "inspections_v")
    + """, it AS (SELECT id, CASE WHEN verdict = 'pass' THEN 'confirmed' ELSE 'pending' END AS status FROM checks_v WHERE (verdict = 'needs_review' OR confidence < 0.7) AND inspection_id IN (SELECT id FROM inspections_v WHERE region = 'ASIA'))
SELECT id, status, (SELECT count(*) FROM it) AS total, (SELECT count(*) FROM it WHERE status = 'pending') AS pending FROM it WHERE status = 'confirmed'"""
)
def g2_review_queue(spark, sf):
    return re_.review_queue(checks(spark, sf), "confirmed", view(spark, sf, "inspections_v"), "ASIA").select("id", "status", "total", "pending")


@query(ITEMS + "SELECT count(*) total, count(*) FILTER (WHERE status = 'pending') pending, count(*) FILTER (WHERE status = 'confirmed') confirmed, round(count(*) FILTER (WHERE status = 'pending') / count(*), 4) pending_ratio FROM it")
def g3_queue_summary(spark, sf):
    return re_.queue_summary(checks(spark, sf))


def _reviews(spark, sf):
    """Reviews of checks: one for each line, dated by its ship date."""
    l = spark.read.parquet(f"{sf}/lineitem.parquet")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return l.select(key.alias("check_id"), F.when(F.col("l_partkey") % 2 == 0, "confirm").otherwise("override").alias("kind"), F.when(F.col("l_partkey") % 5 == 0, "ok").otherwise("misread label").alias("reason"), F.col("l_quantity").cast("string").alias("corrected_value"), F.col("l_shipdate").alias("created_at"))


_REVIEWS = ", rv AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) check_id, CASE WHEN l_partkey % 2 = 0 THEN 'confirm' ELSE 'override' END kind, CASE WHEN l_partkey % 5 = 0 THEN 'ok' ELSE 'misread label' END reason, l_shipdate FROM lineitem), ok AS (SELECT check_id, max(kind) kind FROM rv WHERE kind = 'confirm' OR length(trim(reason)) >= 5 GROUP BY 1) "


@query(CHECKS + _REVIEWS + "SELECT c.id, c.verdict AS verdict_before, CASE WHEN kind IS NOT NULL THEN 'pass' ELSE verdict END AS verdict, CASE WHEN kind IS NOT NULL THEN 1.0 ELSE confidence END AS confidence, coalesce(kind, 'none') AS review FROM checks_v c LEFT JOIN ok ON ok.check_id = c.id")
def g4_apply_reviews(spark, sf):
    return re_.apply_reviews(checks(spark, sf), _reviews(spark, sf)).drop("inspection_id")


@query(CHECKS + _REVIEWS + "SELECT DISTINCT check_id, CASE WHEN field_type IS NULL THEN '{' ELSE '{\"field_type\":\"' || field_type || '\",' END || '\"verdict\":\"' || verdict || '\"}' AS original_value, confidence, reason FROM rv JOIN checks_v c ON c.id = rv.check_id WHERE kind = 'override' AND length(trim(reason)) >= 5")
def g5_correction_rows(spark, sf):
    return re_.correction_rows(_reviews(spark, sf), checks(spark, sf)).select("check_id", "original_value", "confidence", "reason").distinct()


@query(with_views("inspections_v", "checks_v") + ", o AS (SELECT inspection_id, count(*) n, string_agg(DISTINCT coalesce(field_type, 'unknown'), ', ' ORDER BY coalesce(field_type, 'unknown')) fields FROM checks_v WHERE verdict = 'needs_review' GROUP BY 1) SELECT i.id AS inspection_id, n IS NULL AS can_submit, CASE WHEN n IS NULL THEN '' ELSE n || ' field(s) pending review: ' || fields END AS reason FROM inspections_v i LEFT JOIN o ON o.inspection_id = i.id")
def g6_can_submit(spark, sf):
    return re_.can_submit(view(spark, sf, "inspections_v"), checks(spark, sf))


@query(ITEMS + "SELECT inspection_id, id, field_type FROM (SELECT *, row_number() OVER (PARTITION BY inspection_id ORDER BY ord, id) rn FROM it WHERE status = 'pending') WHERE rn = 1")
def g7_first_pending(spark, sf):
    return re_.first_pending(checks(spark, sf))


@query(REQ + f"SELECT {_EV}, (SELECT count(*) FROM ev WHERE action = 'update' AND created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-20') AS total FROM ev WHERE action = 'update' AND created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-20' ORDER BY created_at DESC, event_id LIMIT 50 OFFSET 50")
def h1_audit_page(spark, sf):
    return au.audit_page(events(spark, sf), page=2, page_size=50, since="2024-01-05", until="2024-01-20", action="update").select(*_EV.split(", "), "total")


@query(REQ + f"SELECT {_EV} FROM ev WHERE event_id = 102")
def h2_audit_by_id(spark, sf):
    return au.audit_by_id(events(spark, sf), 102).select(*_EV.split(", "))


@query(REQ + f"SELECT {_EV} FROM ev WHERE event_id = (SELECT max(event_id) FROM events WHERE event_type = 'purchase' AND event_id % 6 = 2)")
def h2_last_rule_change(spark, sf):
    """The last change of a rule, looked up by its id."""
    last = spark.read.parquet(f"{sf}/events.parquet").filter("event_type = 'purchase' AND event_id % 6 = 2").agg(F.max("event_id")).first()[0]
    return au.audit_by_id(events(spark, sf), last).select(*_EV.split(", "))


@query(REQ + f"SELECT {_EV} FROM ev WHERE entity_type = 'rule' AND entity_id = '12'")
def h3_entity_trail(spark, sf):
    return au.entity_trail(events(spark, sf), "rule", "12").select(*_EV.split(", "))


@query(REQ + f"SELECT {_EV}, after_value FROM ev")
def h4_audit_events(spark, sf):
    return events(spark, sf).drop("created_at")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS actor FROM events")
def h5_actor_from_token(spark, sf):
    """Tokens made for every event, one in four malformed, and read."""
    body = F.regexp_replace(F.translate(F.base64(F.concat(F.lit('{"sub":"'), F.col("user_id").cast("string"), F.lit('"}')).cast("binary")), "+/", "-_"), "[=\\s]+", "")
    token = F.when(F.col("event_id") % 4 == 0, F.lit("Bearer x.y")).otherwise(F.concat(F.lit("Bearer h."), body, F.lit(".s")))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", au.actor_from_token(token).alias("actor"))


@query(INS + "SELECT id, overall_status, (SELECT count(*) FROM inspections_v WHERE region = 'ASIA' AND overall_status = 'COMPLIANT') AS total FROM inspections_v WHERE region = 'ASIA' AND overall_status = 'COMPLIANT' ORDER BY created_at DESC, CAST(id AS BIGINT) LIMIT 100")
def i1_list_inspections(spark, sf):
    return ins.list_inspections(view(spark, sf, "inspections_v"), "senior_officer", "7", "ASIA", status="COMPLIANT", page_size=100).select("id", "overall_status", "total")


@query(INS + "SELECT id, CASE WHEN inspector_id = '7' THEN 'allow' ELSE 'deny' END AS access FROM inspections_v")
def i2_access_decision(spark, sf):
    return ins.access_decision(view(spark, sf, "inspections_v"), "inspector", "7")


@query("SELECT doc_id, CASE WHEN lang NOT IN ('en', 'fr') THEN 'mime_type' WHEN n_chars * 10000 > 15728640 THEN 'too_large' ELSE 'none' END AS reject_reason FROM documents")
def i3_validate_uploads(spark, sf):
    mime = F.when(F.col("lang") == "en", "image/jpeg").when(F.col("lang") == "fr", "image/png").otherwise("application/pdf")
    uploads = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", mime.alias("mime_type"), (F.col("n_chars") * 10000).alias("n_bytes"))
    return ins.validate_uploads(uploads).select("doc_id", F.coalesce("reject_reason", F.lit("none")).alias("reject_reason"))


@query(with_views("images_v") + "SELECT id, canonical_id, id <> canonical_id AS is_duplicate FROM (SELECT id, first_value(id) OVER (PARTITION BY content_hash ORDER BY uploaded_at, id) canonical_id FROM images_v)")
def i4_dedup_images(spark, sf):
    return ins.dedup_images(view(spark, sf, "images_v"))


@query()
def i5_pixel_metrics(spark, sf):
    """Grey images of 16 pixels a row made of all bytes of documents; zeros fill up the last row."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("data", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    height = F.greatest(F.lit(1), F.ceil(F.octet_length("data") / 16)).cast("int")
    data = F.expr("rpad(data, cast(greatest(1, ceil(octet_length(data) / 16)) * 16 as int), X'00')")
    image = F.struct(F.col("doc_id").cast("string").alias("origin"), height.alias("height"), F.lit(16).alias("width"), F.lit(1).alias("nChannels"), data.alias("data"))
    out = ins.pixel_metrics(docs.select(image.alias("image")))
    return out.select("origin", "width", "height", *[F.round(c, 6).alias(c) for c in ("laplacian_variance", "bright_ratio", "dark_ratio")])


@query("""SELECT doc_id, round(greatest(0.0, least(1.0, 1.0 - CASE WHEN lv < 150 THEN 0.4 * (150.0 - lv) / 150.0 ELSE 0 END - CASE WHEN br > 0.85 THEN 0.3 ELSE 0 END - CASE WHEN dr > 0.15 THEN 0.25 ELSE 0 END - CASE WHEN w < 640 OR h < 480 THEN 0.15 ELSE 0 END)), 3) AS quality_score,
 concat_ws(',', CASE WHEN lv < 150 THEN 'blurry' END, CASE WHEN br > 0.85 THEN 'overexposed' END, CASE WHEN dr > 0.15 THEN 'underexposed' END, CASE WHEN w < 640 OR h < 480 THEN 'low_resolution' END) AS issues
 FROM (SELECT doc_id, CAST(n_chars % 301 AS DOUBLE) lv, CAST(doc_id % 100 / 100.0 AS DOUBLE) br, CAST(doc_id % 17 / 100.0 AS DOUBLE) dr, 600 + doc_id % 100 AS w, 400 + doc_id % 200 AS h FROM documents)""")
def i6_quality_score(spark, sf):
    d, n = F.col("doc_id"), F.col("n_chars")
    metrics = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", (n % 301).cast("double").alias("laplacian_variance"), (d % 100 / F.lit(100.0)).alias("bright_ratio"), (d % 17 / F.lit(100.0)).alias("dark_ratio"), (600 + d % 100).alias("width"), (400 + d % 200).alias("height"))
    return ins.quality_score(metrics).select("doc_id", "quality_score", F.array_join("quality_issues", ",").alias("issues"))


@query(with_views("boxes_v") + "SELECT image_id, round(avg(y2 - y1), 6) AS mean_height, avg(y2 - y1) < 40 AS needs_upscale FROM boxes_v WHERE x2 - x1 > 5 AND y2 - y1 > 5 GROUP BY 1")
def i7_needs_upscale(spark, sf):
    return ins.needs_upscale(view(spark, sf, "boxes_v"), 40.0).select("image_id", F.round("mean_height", 6).alias("mean_height"), "needs_upscale")


def _manifest(spark, sf):
    d, n = F.col("doc_id"), F.col("n_chars")
    return spark.read.parquet(f"{sf}/documents.parquet").select(d.alias("ord"), F.sha2("text", 256).alias("sha1"), F.concat(F.lit("t"), (n % 900).cast("string")).alias("title"), F.col("source").alias("author"), (500 + n % 700).alias("width"), (300 + d % 400).alias("height"))


@query("WITH m AS (SELECT doc_id AS ord, sha256(text) sha1, 't' || (n_chars % 900) title, 500 + n_chars % 700 AS w, 300 + doc_id % 400 AS h FROM documents), f AS (SELECT * FROM m WHERE w >= 640 AND h >= 420 AND w <= 3 * h AND h <= 3 * w), a AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY sha1 ORDER BY ord) = 1), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY title ORDER BY ord) = 1), c AS (SELECT * FROM b ORDER BY ord LIMIT 60) SELECT ord, title, printf('photo_%04d.jpg', row_number() OVER (ORDER BY ord)) AS file_name FROM c")
def i8_select_photos(spark, sf):
    return ins.select_photos(_manifest(spark, sf), 60).select("ord", "title", "file_name")


@query("SELECT DISTINCT source AS author, 't' || (n_chars % 900) AS title FROM documents")
def i9_credits(spark, sf):
    rows = _manifest(spark, sf)
    return ins.credits(rows, rows.filter("ord % 2 = 0"))


@query(INS + "SELECT count(*) total_inspections, count(*) FILTER (WHERE overall_status = 'COMPLIANT') compliant, count(*) FILTER (WHERE overall_status = 'NON_COMPLIANT') non_compliant, count(*) FILTER (WHERE overall_status = 'FLAGGED_FOR_REVIEW') flagged, count(*) FILTER (WHERE overall_status = 'NEEDS_HUMAN_REVIEW') needs_review, count(*) FILTER (WHERE overall_status IN ('NON_COMPLIANT', 'FLAGGED_FOR_REVIEW')) active_violations, round(count(*) FILTER (WHERE overall_status = 'COMPLIANT') / count(*) FILTER (WHERE overall_status IN ('COMPLIANT', 'NON_COMPLIANT', 'FLAGGED_FOR_REVIEW')) * 100, 1) compliance_rate, (SELECT count(*) FROM products_v) total_products FROM inspections_v")
def l1_kpis(spark, sf):
    return da.kpis(view(spark, sf, "inspections_v"), view(spark, sf, "products_v"))


@query(INS + "SELECT category, count(*) AS n FROM inspections_v i JOIN products_v p ON i.product_id = p.id WHERE overall_status IN ('NON_COMPLIANT', 'FLAGGED_FOR_REVIEW') AND category IS NOT NULL GROUP BY 1 ORDER BY n DESC, category LIMIT 1")
def l2_top_category(spark, sf):
    return da.top_category(view(spark, sf, "inspections_v"), view(spark, sf, "products_v"))


@query(INS + ", c AS (SELECT date_trunc('month', created_at) m, count(*) total, count(*) FILTER (WHERE overall_status = 'COMPLIANT') compliant, count(*) FILTER (WHERE overall_status IN ('NON_COMPLIANT', 'FLAGGED_FOR_REVIEW')) bad FROM inspections_v GROUP BY 1), s AS (SELECT unnest(generate_series((SELECT min(m) FROM c), (SELECT max(m) FROM c), INTERVAL 1 MONTH)) m) SELECT strftime(s.m, '%Y-%m') AS month, coalesce(total, 0) total, coalesce(compliant, 0) compliant, coalesce(bad, 0) bad, CASE WHEN total > 0 THEN round(compliant / total * 100, 1) ELSE 0.0 END AS rate, CAST(floor(coalesce(total, 0) * CAST(0.8 AS DOUBLE)) AS BIGINT) AS compliant_estimate FROM s LEFT JOIN c ON s.m = c.m")
def l3_trends(spark, sf):
    return da.trends(view(spark, sf, "inspections_v"))


@query(INS + ", r AS (SELECT coalesce(category, 'Uncategorized') category, count(i.id) inspections, count(*) FILTER (WHERE overall_status IN ('NON_COMPLIANT', 'FLAGGED_FOR_REVIEW')) violations FROM products_v p LEFT JOIN inspections_v i ON i.product_id = p.id GROUP BY 1) SELECT category, inspections, violations, CASE WHEN inspections > 0 THEN round(violations / inspections * 100, 1) ELSE 0.0 END AS violation_rate, CAST((SELECT sum(inspections) FROM r) AS BIGINT) AS total FROM r")
def l4_category_rates(spark, sf):
    return da.category_rates(view(spark, sf, "inspections_v"), view(spark, sf, "products_v"))
