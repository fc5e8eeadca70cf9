"""Queries of boxes, annotation and detector evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataset as ds
from ..operators import geometry as ge
from ..sources import files
from ..sources.adapters import view, with_views
from .registry import query

BOXES = with_views("boxes_v")
_IOU = lambda a, b: (
    f"CASE WHEN ({a}.x2-{a}.x1)*({a}.y2-{a}.y1) + ({b}.x2-{b}.x1)*({b}.y2-{b}.y1) - greatest(0, least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))*greatest(0, least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1)) > 0 THEN "
    f"greatest(0, least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))*greatest(0, least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1)) / (({a}.x2-{a}.x1)*({a}.y2-{a}.y1) + ({b}.x2-{b}.x1)*({b}.y2-{b}.y1) - greatest(0, least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))*greatest(0, least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1))) ELSE 0 END"
)
_C = ("x1", "y1", "x2", "y2")


def boxes(spark, sf):
    return view(spark, sf, "boxes_v")


@query(BOXES + "SELECT image_id, seq, x2 - x1 AS width, y2 - y1 AS height, (x2 - x1) * (y2 - y1) AS area, CAST(floor((x1 + x2) / 2) AS BIGINT) AS cx, CAST(floor((y1 + y2) / 2) AS BIGINT) AS cy, (x1 + x2) / 2.0 AS px, (y1 + y2) / 2.0 AS py, y2 - y1 AS ph FROM boxes_v")
def j1_box_measures(spark, sf):
    p = lambda x, y: F.array(F.col(x), F.col(y))
    px, py, ph = ge.polygon_measures(F.array(p("x1", "y1"), p("x2", "y1"), p("x2", "y2"), p("x1", "y2")))
    rows = ge.box_measures(boxes(spark, sf)).withColumn("px", px).withColumn("py", py).withColumn("ph", ph)
    return rows.select("image_id", "seq", "width", "height", "area", "cx", "cy", "px", "py", "ph")


@query(BOXES + f"SELECT a.image_id, a.seq AS s1, b.seq AS s2, round({_IOU('a', 'b')}, 6) AS iou FROM boxes_v a JOIN boxes_v b ON a.image_id = b.image_id AND a.seq < b.seq AND a.class_name = b.class_name")
def j2_iou(spark, sf):
    a = boxes(spark, sf).select("image_id", "class_name", F.col("seq").alias("s1"), F.struct(*_C).alias("a"))
    b = boxes(spark, sf).select("image_id", "class_name", F.col("seq").alias("s2"), F.struct(*_C).alias("b"))
    return a.join(b, ["image_id", "class_name"]).filter("s1 < s2").select("image_id", "s1", "s2", F.round(ge.iou(F.col("a"), F.col("b")), 6).alias("iou"))


@query()
def j3_nms(spark, sf):
    return ge.nms(boxes(spark, sf)).drop("confidence")


@query(BOXES + ", p AS (SELECT image_id, seq, (x1 + x2) / 2.0 AS cx, (y1 + y2) / 2.0 AS cy, x2 - x1 AS w, y2 - y1 AS h, confidence, CASE WHEN class_name = 'package' THEN confidence ELSE 0.3 END AS s0, CASE WHEN class_name = 'label' THEN confidence ELSE 0.2 END AS s1 FROM boxes_v) SELECT image_id, greatest(0, least(100, CAST(trunc((cx - w / 2.0 - 2) / 0.5) AS INT))) AS x1, greatest(0, least(90, CAST(trunc((cy - h / 2.0 - 3) / 0.5) AS INT))) AS y1, greatest(0, least(100, CAST(trunc((cx + w / 2.0 - 2) / 0.5) AS INT))) AS x2, greatest(0, least(90, CAST(trunc((cy + h / 2.0 - 3) / 0.5) AS INT))) AS y2, s0 AS confidence FROM p WHERE s0 >= s1 AND s0 >= 0.5")
def j4_decode_predictions(spark, sf):
    package = F.col("class_name") == "package"
    rows = boxes(spark, sf).select(
        "image_id", ((F.col("x1") + F.col("x2")) / F.lit(2.0)).alias("cx"), ((F.col("y1") + F.col("y2")) / F.lit(2.0)).alias("cy"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"),
        F.array(F.when(package, F.col("confidence")).otherwise(0.3), F.when(~package, F.col("confidence")).otherwise(0.2)).alias("scores"), F.lit(0.5).alias("ratio"), F.lit(2).alias("pad_x"), F.lit(3).alias("pad_y"), F.lit(100).alias("width"), F.lit(90).alias("height"),
    )
    return ge.decode_predictions(rows, ["package", "label"], "package").drop("class_name")


def images(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("image_id"), F.lit(120).alias("width"), F.lit(100).alias("height"))


@query(BOXES + ", p AS (SELECT * FROM boxes_v WHERE class_name = 'package' QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, seq) = 1), q AS (SELECT * FROM p WHERE confidence >= 0.5) SELECT o_orderkey AS image_id, coalesce(x1, 0) x1, coalesce(y1, 0) y1, coalesce(x2, 120) x2, coalesce(y2, 100) y2, coalesce(confidence, 0.3) confidence, q.image_id IS NULL AS manual_crop_used FROM orders LEFT JOIN q ON o_orderkey = image_id")
def j5_package_boxes(spark, sf):
    return ge.package_boxes(images(spark, sf), boxes(spark, sf)).drop("n_packages")


@query()
def j6_label_boxes(spark, sf):
    return ge.label_boxes(ge.package_boxes(images(spark, sf), boxes(spark, sf)), boxes(spark, sf)).drop("class_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN valid AND share > 0 AND share <= 1 AND share >= 0.015 THEN round(share, 6) END AS relative_size, CASE WHEN NOT (valid AND share > 0 AND share <= 1) THEN 'illegible' WHEN share >= 0.03 THEN 'legible' WHEN share >= 0.015 THEN 'marginal' WHEN share >= 0.008 THEN 'degraded' ELSE 'illegible' END AS text_region_type, NOT (valid AND share > 0 AND share <= 1 AND share >= 0.015) AS is_unable_to_verify FROM (SELECT *, t > 0 AND p > 0 AS valid, CASE WHEN t > 0 AND p > 0 THEN t / p END AS share FROM (SELECT *, CAST(l_quantity AS INT) - 2 AS t, l_partkey % 3000 - 5 AS p FROM lineitem))")
def j7_font_size(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit(0).alias("ty1"), (F.col("l_quantity").cast("int") - 2).alias("ty2"), F.lit(0).alias("py1"), (F.col("l_partkey") % 3000 - 5).alias("py2"))
    out = ge.font_size(rows)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("relative_size", 6).alias("relative_size"), "text_region_type", "is_unable_to_verify")


@query(BOXES + "SELECT image_id, seq, (x1 + x2) / 2.0 BETWEEN 30 AND 70 AND (y1 + y2) / 2.0 BETWEEN 20 AND 60 AS is_inside, greatest(least(x1, 70), 30) AS cx1, greatest(least(y2, 60), 20) AS cy2, CAST(floor(x1 + (x2 - x1) * CAST(0.19 AS DOUBLE)) AS INT) AS mx1, CAST(floor(y1 + (y2 - y1) * CAST(0.78 AS DOUBLE)) AS INT) AS my2 FROM boxes_v")
def j8_clip(spark, sf):
    at = {c: F.lit(v) for c, v in zip(_C, (30, 20, 70, 60))}
    own = {c: F.col(c) for c in _C}
    cut, middle = ge.clip(own, at), ge.central_box(own)
    return boxes(spark, sf).select("image_id", "seq", ge.inside((own["x1"] + own["x2"]) / F.lit(2.0), (own["y1"] + own["y2"]) / F.lit(2.0), at).alias("is_inside"), cut["x1"].alias("cx1"), cut["y2"].alias("cy2"), middle["x1"].alias("mx1"), middle["y2"].alias("my2"))


def _metrics(spark, sf):
    d, n = F.col("doc_id"), F.col("n_chars")
    return spark.read.parquet(f"{sf}/documents.parquet").select(d.alias("image_id"), F.when(d % 13 != 0, 400 + d % 300).alias("width"), (450 + n % 200).alias("height"), (n % 200).cast("double").alias("laplacian_variance"), (d % 50).cast("double").alias("std"))


_QC = "CASE WHEN doc_id % 13 = 0 THEN 'undecodable' WHEN least(400 + doc_id % 300, 450 + n_chars % 200) < 480 THEN 'too_small' WHEN n_chars % 200 < 40 THEN 'blurry' WHEN doc_id % 50 < 12 THEN 'monochrome' END"


@query(f"SELECT doc_id AS image_id, coalesce({_QC}, 'none') AS skip_reason FROM documents")
def k1_qc_reason(spark, sf):
    return ds.qc_reason(_metrics(spark, sf)).select("image_id", F.coalesce("skip_reason", F.lit("none")).alias("skip_reason"))


@query(BOXES + "SELECT image_id, class_name, seq, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id, class_name ORDER BY confidence DESC, seq) rn FROM boxes_v WHERE confidence >= 0.4 AND (x2 - x1) * (y2 - y1) >= 0.03 * 50000) WHERE rn <= 3")
def k2_proposal_filter(spark, sf):
    return ds.proposal_filter(boxes(spark, sf), 0.4, 50000).select("image_id", "class_name", "seq", F.col("rn").cast("long").alias("rank"))


def _models(spark, sf):
    rows = ds.proposal_filter(boxes(spark, sf), 0.1, 1000).drop("rn")
    return rows.filter("class_name = 'package'"), rows.filter("class_name = 'label'")


@query()
def k3_merge_proposals(spark, sf):
    return ds.merge_proposals(*_models(spark, sf)).drop("confidence")


_CHOICE = (
    BOXES
    + """, p AS (SELECT * FROM boxes_v WHERE class_name = 'package' QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, seq) = 1), q AS (SELECT * FROM p WHERE confidence >= 0.5),
k AS (SELECT o_orderkey AS image_id, coalesce(x1, 0) px1, coalesce(y1, 0) py1, coalesce(x2, 120) px2, coalesce(y2, 100) py2 FROM orders LEFT JOIN q ON o_orderkey = image_id),
c AS (SELECT b.*, b.seq % 2 AS source FROM boxes_v b JOIN k USING (image_id) WHERE class_name = 'label' AND x2 - x1 >= 12 AND y2 - y1 >= 12 AND (x1 + x2) / 2 BETWEEN px1 AND px2 AND (y1 + y2) / 2 BETWEEN py1 AND py2),
l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY source, confidence DESC, seq) = 1),
m AS (SELECT k.*, CAST(0.19 AS DOUBLE) a, CAST(0.18 AS DOUBLE) b, CAST(0.81 AS DOUBLE) c, CAST(0.78 AS DOUBLE) d, px2 - px1 AS w, py2 - py1 AS h FROM k)
SELECT m.image_id, CASE WHEN l.image_id IS NULL THEN 'central' WHEN source = 0 THEN 'first' ELSE 'second' END AS origin, CAST(coalesce(x1, floor(px1 + w * a)) AS INT) x1, CAST(coalesce(y1, floor(py1 + h * b)) AS INT) y1,
 CAST(coalesce(x2, floor(px1 + w * m.c)) AS INT) x2, CAST(coalesce(y2, floor(py1 + h * d)) AS INT) y2 FROM m LEFT JOIN l USING (image_id)"""
)


@query(_CHOICE)
def k4_choose_label(spark, sf):
    return _labels(spark, sf)


def _labels(spark, sf):
    labels = boxes(spark, sf).filter("class_name = 'label'")
    return ds.choose_label(ge.package_boxes(images(spark, sf), boxes(spark, sf)), labels.filter("seq % 2 = 0"), labels.filter("seq % 2 = 1"))


def _entries(spark, sf):
    return ds.image_entries(boxes(spark, sf).withColumn("agreed", F.col("x1") > 50))


_ENTRIES = BOXES + ", en AS (SELECT image_id, count(*) n_boxes, round(max(confidence), 3) top_confidence, bool_or(x1 > 50) agreed, round(max(confidence), 3) >= 0.45 OR bool_or(x1 > 50) AS strict FROM boxes_v GROUP BY 1) "


@query(_ENTRIES + "SELECT image_id, n_boxes, top_confidence, agreed, strict FROM en")
def k5_image_entries(spark, sf):
    return _entries(spark, sf)


@query(_ENTRIES + ", c AS (SELECT count(*) n, count(*) FILTER (WHERE strict) s FROM en) SELECT 'val' AS split, least(greatest(1, CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT)), s) AS n FROM c UNION ALL SELECT 'train', n - least(greatest(1, CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT)), s) FROM c")
def k6_split_train_val(spark, sf):
    """How many images go to each side; which ones is up to the hash."""
    return ds.split_train_val(_entries(spark, sf)).groupBy("split").agg(F.count("*").alias("n"))


@query(_ENTRIES + f", q AS (SELECT {_QC} AS r FROM documents) SELECT 'accepted' AS metric, CAST(count(*) AS DOUBLE) AS value FROM en UNION ALL SELECT 'agreement_rate', round(count(*) FILTER (WHERE agreed) / count(*), 3) FROM en UNION ALL SELECT 'strict_rate', round(count(*) FILTER (WHERE strict) / count(*), 3) FROM en UNION ALL SELECT 'skipped_' || split_part(r, '_', 1), CAST(count(*) AS DOUBLE) FROM q WHERE r IS NOT NULL GROUP BY 1")
def k7_annotation_summary(spark, sf):
    return ds.annotation_summary(_entries(spark, sf), ds.qc_reason(_metrics(spark, sf)))


@query(_ENTRIES + "SELECT image_id, n_boxes, pool FROM (SELECT *, CASE WHEN image_id % 2 = 0 THEN 'a' ELSE 'b' END AS pool FROM en) WHERE strict AND image_id IN (SELECT image_id FROM boxes_v WHERE class_name = 'label')")
def k8_combine_datasets(spark, sf):
    rows = _entries(spark, sf)
    even = F.col("image_id") % 2 == 0
    return ds.combine_datasets(rows.filter(even).withColumn("pool", F.lit("a")), rows.filter(~even).withColumn("pool", F.lit("b")), boxes(spark, sf).filter("class_name = 'label'"), strict_only=True).select("image_id", "n_boxes", "pool")


@query(f"SELECT 'label_fallback_rate' AS metric, round(count(*) FILTER (WHERE image_id IN (SELECT image_id FROM ({_CHOICE}) WHERE origin = 'central')) / count(*), 3) AS value FROM (SELECT DISTINCT l_orderkey AS image_id FROM lineitem)")
def k7_label_fallback_rate(spark, sf):
    return ds.label_fallback_rate(_entries(spark, sf), _labels(spark, sf))


@query(_ENTRIES + """, s AS (SELECT image_id % 2 = 0 AS synthetic, image_id % 5 = 0 AS val, count(*) AS n, count(*) FILTER (WHERE strict) AS k FROM en GROUP BY ALL)
SELECT CASE WHEN synthetic THEN 'synthetic' ELSE 'real' END AS pool, CASE WHEN val THEN 'val' ELSE 'train' END AS split, CAST(sum(CASE WHEN synthetic AND val THEN least(n, 20) WHEN synthetic OR val THEN n ELSE k END) AS BIGINT) AS n FROM s GROUP BY ALL""")
def k8_combined_splits(spark, sf):
    """Pools and splits of a combined set with a sample of synthetic images to validate on: how many images each has."""
    rows = _entries(spark, sf).withColumn("split", F.when(F.col("image_id") % 5 == 0, "val").otherwise("train"))
    even = F.col("image_id") % 2 == 0
    return ds.combine_splits(rows.filter(even), rows.filter(~even), boxes(spark, sf), strict_only=True).groupBy("pool", "split").agg(F.count("*").alias("n"))


def _matches(spark, sf):
    rows = boxes(spark, sf)
    return ds.match_predictions(rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1")), rows.filter("seq % 2 = 1")


@query()
def k9_match_predictions(spark, sf):
    return _matches(spark, sf)[0].drop("confidence")


_AP = BOXES + """, m AS (SELECT image_id, class_name, seq, confidence, x1 % 3 = 0 AS tp FROM boxes_v), t AS (SELECT class_name, count(*) n_truth FROM boxes_v GROUP BY 1),
c AS (SELECT m.*, n_truth, sum(CAST(tp AS INT)) OVER w AS tps, row_number() OVER w AS n FROM m JOIN t USING (class_name) WINDOW w AS (PARTITION BY class_name ORDER BY confidence DESC, image_id, seq)),
e AS (SELECT *, max(tps / n) OVER (PARTITION BY class_name ORDER BY confidence DESC, image_id, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env, tps / n_truth AS recall, lag(tps / n_truth, 1, 0.0) OVER (PARTITION BY class_name ORDER BY confidence DESC, image_id, seq) AS before FROM c),
ap AS (SELECT class_name, any_value(n_truth) n_truth, round(sum((recall - before) * env), 3) AS ap50 FROM e GROUP BY 1) """


def _ap(spark, sf):
    rows = boxes(spark, sf)
    return ds.average_precision(rows.withColumn("tp", F.col("x1") % 3 == 0), rows)


@query(_AP + "SELECT class_name, n_truth, ap50 FROM ap")
def k10_average_precision(spark, sf):
    return _ap(spark, sf)


@query(_AP + "SELECT round(avg(ap50), 3) AS map50, count(ap50) AS n_classes, CAST(sum(n_truth) AS BIGINT) AS n_truth FROM ap")
def k11_mean_ap(spark, sf):
    return ds.mean_ap(_ap(spark, sf))


_LINES = BOXES + ", ln AS (SELECT image_id, seq, printf('%d %.6f %.6f %.6f %.6f', CASE class_name WHEN 'package' THEN 0 ELSE 1 END, (x1 + x2) / 2.0 / 120, (y1 + y2) / 2.0 / 100, (x2 - x1) / 120.0, (y2 - y1) / 100.0) AS value, x1, y1, x2, y2 FROM boxes_v) "


def _lines(spark, sf):
    return files.yolo_lines(boxes(spark, sf).withColumn("width", F.lit(120)).withColumn("height", F.lit(100)))


@query(_LINES + "SELECT image_id, x1, y1, x2, y2, count(*) AS n FROM ln GROUP BY ALL")
def a5_read_yolo_labels(spark, sf):
    """Lines of annotation, and some with a field too few, read as boxes: what was written."""
    lines = _lines(spark, sf).select("image_id", "value")
    broken = lines.withColumn("value", F.regexp_replace("value", r" \S+$", ""))
    out = files.parse_yolo_lines(lines.unionByName(broken), images(spark, sf))
    return out.groupBy("image_id", *_C).agg(F.count("*").alias("n"))


@query(_LINES + "SELECT image_id, seq, value FROM ln")
def a6_yolo_lines(spark, sf):
    return _lines(spark, sf)
