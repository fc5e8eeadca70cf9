"""Boxes: measures, overlap, suppression and font size, without Python in the tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERLAP, PACKAGE_CONFIDENCE = 0.45, 0.5
# Text height as a share of package height, name and confidence of each band.
FONT_BANDS = [(0.03, "legible", 0.9), (0.015, "marginal", 0.65), (0.008, "degraded", 0.45)]


def box_measures(boxes: DataFrame) -> DataFrame:
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return boxes.withColumn("width", w).withColumn("height", h).withColumn("area", w * h).withColumn("cx", F.floor((F.col("x1") + F.col("x2")) / 2)).withColumn("cy", F.floor((F.col("y1") + F.col("y2")) / 2))


def polygon_measures(polygon: Column) -> tuple[Column, Column, Column]:
    """Centre (mean of the points) and height of a polygon of (x, y) points."""
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return mean(xs), mean(ys), F.array_max(ys) - F.array_min(ys)


def iou(a, b) -> Column:
    """Intersection over union of two boxes, given as structs or anything with their corners; 0 without an area."""
    side = lambda lo, hi: F.greatest(F.lit(0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    area = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])
    both = side("x1", "x2") * side("y1", "y2")
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


_BOX = "struct<k:double,seq:long,x1:int,y1:int,x2:int,y2:int,confidence:double>"


def nms(boxes: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """Of each image and class the boxes that no better box covers by more than ``overlap``: greedily, the most confident
    first, equals by seq. The boxes of one image are few; they are gathered in a row."""
    one = F.struct((-F.col("confidence")).alias("k"), F.col("seq").cast("long").alias("seq"), *[F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")], "confidence")
    rows = boxes.groupBy("image_id", "class_name").agg(F.array_sort(F.collect_list(one)).alias("all"))
    kept = F.aggregate("all", F.array().cast(f"array<{_BOX}>"), lambda acc, x: F.when(F.exists(acc, lambda y: iou(x, y) > overlap), acc).otherwise(F.concat(acc, F.array(x))))
    return rows.select("image_id", "class_name", F.explode(kept).alias("b")).select("image_id", "class_name", "b.seq", "b.x1", "b.y1", "b.x2", "b.y2", "b.confidence")


def decode_predictions(predictions: DataFrame, classes: list[str], target: str, least: float = 0.5) -> DataFrame:
    """Raw predictions (image_id, cx, cy, w, h, scores, ratio, pad_x, pad_y, width, height) as boxes inside the image."""
    best = F.array_max("scores")
    name = F.get(F.array(*map(F.lit, classes)), F.array_position("scores", best).cast("int") - 1)
    edge = lambda c, size, sign, pad, most: F.greatest(F.lit(0), F.least(F.col(most), F.expr(f"int(({c} {sign} {size} / 2 - {pad}) / ratio)")))
    rows = predictions.withColumn("confidence", best).withColumn("class_name", name).filter((F.col("confidence") >= least) & (F.col("class_name") == target))
    return rows.select("image_id", "class_name", edge("cx", "w", "-", "pad_x", "width").alias("x1"), edge("cy", "h", "-", "pad_y", "height").alias("y1"), edge("cx", "w", "+", "pad_x", "width").alias("x2"), edge("cy", "h", "+", "pad_y", "height").alias("y2"), "confidence")


def package_boxes(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """The primary package of each image (image_id, width, height); without one, the whole image at 0.3."""
    kept = nms(boxes.filter("class_name = 'package'")).filter(F.col("confidence") >= PACKAGE_CONFIDENCE)
    primary = kept.groupBy("image_id").agg(F.min_by(F.struct("x1", "y1", "x2", "y2", "confidence"), F.struct(-F.col("confidence"), F.col("seq"))).alias("b"), F.count("*").alias("n"))
    rows, none = images.join(primary, "image_id", "left"), F.col("b").isNull()
    pick = lambda c, other: F.when(none, other).otherwise(F.col(f"b.{c}")).alias(c)
    return rows.select("image_id", pick("x1", F.lit(0)), pick("y1", F.lit(0)), pick("x2", F.col("width")), pick("y2", F.col("height")), pick("confidence", F.lit(0.3)), none.alias("manual_crop_used"), F.coalesce("n", F.lit(0)).alias("n_packages"))


def clip(box: dict, to: dict) -> dict:
    """Corners of ``box`` moved into ``to``."""
    return {c: F.greatest(F.least(box[c], to[f"{c[0]}2"]), to[f"{c[0]}1"]) for c in ("x1", "y1", "x2", "y2")}


def inside(cx: Column, cy: Column, box: dict) -> Column:
    return (cx >= box["x1"]) & (cx <= box["x2"]) & (cy >= box["y1"]) & (cy <= box["y2"])


def central_box(box: dict) -> dict:
    """The middle of a package, where no label is found: 19 to 81 % across, 18 to 78 % down."""
    w, h = box["x2"] - box["x1"], box["y2"] - box["y1"]
    at = lambda lo, size, share: F.floor(lo + size * F.lit(share)).cast("int")
    return {"x1": at(box["x1"], w, 0.19), "y1": at(box["y1"], h, 0.18), "x2": at(box["x1"], w, 0.81), "y2": at(box["y1"], h, 0.78)}


_CORNERS = ("x1", "y1", "x2", "y2")


def label_boxes(packages: DataFrame, boxes: DataFrame) -> DataFrame:
    """Labels clipped to the package of their image, suppressed; the package itself at 0.4 where none is left."""
    p = packages.select("image_id", *[F.col(c).alias(f"p{c}") for c in _CORNERS])
    rows = boxes.filter("class_name = 'label'").join(p, "image_id")
    inner = clip({c: F.col(c) for c in _CORNERS}, {c: F.col(f"p{c}") for c in _CORNERS})
    cut = rows.select("image_id", "seq", "class_name", "confidence", *[v.alias(c) for c, v in inner.items()]).filter("x2 > x1 and y2 > y1")
    kept = nms(cut)
    rest = p.join(kept.select("image_id").distinct(), "image_id", "left_anti").select("image_id", F.lit("label").alias("class_name"), F.lit(-1).cast("long").alias("seq"), *[F.col(f"p{c}").alias(c) for c in _CORNERS], F.lit(0.4).alias("confidence"))
    return kept.unionByName(rest)


def font_size(rows: DataFrame) -> DataFrame:
    """Font size of text boxes (ty1, ty2) against their package (py1, py2): share, band, confidence, whether it can't be told, and a note."""
    text, package = F.col("ty2") - F.col("ty1"), F.col("py2") - F.col("py1")
    valid = (text > 0) & (package > 0)
    share = F.when(valid, text / package)
    fits = F.coalesce((share > 0) & (share <= 1), F.lit(False))
    band, sure = None, None
    for least, name, confidence in FONT_BANDS:
        band = F.when(share >= least, name) if band is None else band.when(share >= least, name)
        sure = F.when(share >= least, confidence) if sure is None else sure.when(share >= least, confidence)
    band, sure = F.when(fits, band.otherwise("illegible")).otherwise("illegible"), F.when(fits, sure.otherwise(0.2)).otherwise(0.0)
    unable = ~fits | (sure < 0.5)
    percent = F.format_string("%.1f%%", share * 100)
    note = F.when(~valid, "Invalid bounding box dimensions").when(~fits, "Text-to-package ratio out of valid range").when(unable, "Unable to verify precisely").when(band == "legible", F.concat(F.lit("Font about "), percent, F.lit(" of label height"))).otherwise(F.concat(F.lit("Font roughly "), percent, F.lit(" of label height")))
    return rows.withColumn("relative_size", F.when(~unable, share)).withColumn("text_region_type", band).withColumn("measurement_confidence", sure).withColumn("is_unable_to_verify", unable).withColumn("notes", note)
