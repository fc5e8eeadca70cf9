"""Inspections and their images: access, uploads, duplicates and quality."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MIME_TYPES, MOST_BYTES = ("image/jpeg", "image/png", "image/webp"), 15 * 1024 * 1024
BLURRY, TOO_BRIGHT, TOO_DARK, LEAST_WIDTH, LEAST_HEIGHT = 150.0, 0.85, 0.15, 640, 480


def visible(inspections: DataFrame, role: str, user_id: str, region: str | None = None) -> DataFrame:
    """What a role may see: inspectors their own, senior officers their region, admins all."""
    if role == "inspector":
        return inspections.filter(F.col("inspector_id") == user_id)
    return inspections.filter(F.col("region") == region) if role == "senior_officer" and region else inspections


def list_inspections(inspections: DataFrame, role: str, user_id: str, region: str | None = None, status: str | None = None, since: str | None = None, page: int = 1, page_size: int = 20) -> DataFrame:
    """A page of what may be seen, newest first, with the number of all."""
    rows = visible(inspections, role, user_id, region)
    if status:
        rows = rows.filter(F.col("overall_status") == status)
    if since:
        rows = rows.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    top = rows.orderBy(F.desc("created_at"), F.col("id").cast("long")).offset((page - 1) * page_size).limit(page_size)
    return top.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


def access_decision(inspections: DataFrame, role: str, user_id: str, region: str | None = None) -> DataFrame:
    own, near = F.col("inspector_id").eqNullSafe(F.lit(user_id)), F.col("region").isNull() | (F.col("region") == F.lit(region))
    allowed = own if role == "inspector" else near if role == "senior_officer" and region else F.lit(True)
    return inspections.select("id", F.when(allowed, "allow").otherwise("deny").alias("access"))


def validate_uploads(uploads: DataFrame) -> DataFrame:
    """Uploads (mime_type, n_bytes) with why they are refused, or null."""
    return uploads.withColumn("reject_reason", F.when(~F.coalesce(F.col("mime_type").isin(*MIME_TYPES), F.lit(False)), "mime_type").when(F.col("n_bytes") > MOST_BYTES, "too_large"))


def dedup_images(images: DataFrame) -> DataFrame:
    """The first upload of each content stays; later ones point at it. A partial minimum meets a hot content first."""
    first = images.groupBy("content_hash").agg(F.min_by("id", F.struct("uploaded_at", "id")).alias("canonical_id"))
    return images.join(first, "content_hash").select("id", "canonical_id", (F.col("id") != F.col("canonical_id")).alias("is_duplicate"))


def pixel_metrics(images: DataFrame) -> DataFrame:
    """Of images in Spark's image layout: variance of the Laplacian of the grey values, and shares of bright and dark pixels."""
    import numpy as np
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for origin, height, width, channels, data in zip(batch["origin"], batch["height"], batch["width"], batch["nChannels"], batch["data"]):
                m = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
                grey = m[:, :, 0] if channels == 1 else np.rint(0.114 * m[:, :, 0] + 0.587 * m[:, :, 1] + 0.299 * m[:, :, 2])
                # the border is mirrored without repeating the edge
                p = np.pad(grey, 1, mode="reflect")
                laplacian = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * grey
                rows.append((origin, width, height, float(laplacian.var()), float((grey >= 240).mean()), float((grey <= 15).mean())))
            yield pd.DataFrame(rows, columns=["origin", "width", "height", "laplacian_variance", "bright_ratio", "dark_ratio"])

    flat = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return flat.mapInPandas(run, "origin string, width int, height int, laplacian_variance double, bright_ratio double, dark_ratio double")


def quality_score(metrics: DataFrame) -> DataFrame:
    """Flags, score, issues in order, and the gate, from laplacian_variance, bright_ratio, dark_ratio, width and height."""
    blurry, bright, dark = F.col("laplacian_variance") < BLURRY, F.col("bright_ratio") > TOO_BRIGHT, F.col("dark_ratio") > TOO_DARK
    small = (F.col("width") < LEAST_WIDTH) | (F.col("height") < LEAST_HEIGHT)
    blur = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(BLURRY) - F.col("laplacian_variance")) / BLURRY))
    off = lambda flag, by: F.when(flag, by).otherwise(F.lit(0.0))
    score = F.lit(1.0) - off(blurry, F.lit(0.4) * blur) - off(bright, F.lit(0.3)) - off(dark, F.lit(0.25)) - off(small, F.lit(0.15))
    issues = F.filter(F.array(F.when(blurry, "blurry"), F.when(bright, "overexposed"), F.when(dark, "underexposed"), F.when(small, "low_resolution")), lambda x: x.isNotNull())
    out = metrics.withColumn("quality_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)).withColumn("quality_issues", issues)
    return out.withColumn("gate_passed", (F.col("quality_score") > 0.5) & ~blurry).withColumn("pipeline_passed", F.col("quality_score") >= 0.7)


def needs_upscale(boxes: DataFrame, least: float = 12.0) -> DataFrame:
    """Images whose boxes of over 5 by 5 pixels are less than 12 high in the mean."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return boxes.filter((w > 5) & (h > 5)).groupBy("image_id").agg(F.avg(h).alias("mean_height")).withColumn("needs_upscale", F.col("mean_height") < least)


def select_photos(manifest: DataFrame, most: int) -> DataFrame:
    """At most ``most`` photos that are large and not too long, the first of each content and title, named in order."""
    w, h = F.col("width"), F.col("height")
    fit = manifest.filter((w >= 640) & (h >= 420) & (w <= 3 * h) & (h <= 3 * w))
    first = lambda df, key: df.join(df.groupBy(key).agg(F.min("ord").alias("ord")), [key, "ord"], "left_semi")
    chosen = first(first(fit, "sha1"), "title").orderBy("ord").limit(most)
    return chosen.withColumn("file_name", F.format_string("photo_%04d.jpg", F.row_number().over(W.orderBy("ord"))))


def credits(manifest: DataFrame, prior: DataFrame) -> DataFrame:
    """Who is to be named, each once."""
    return prior.select("author", "title").union(manifest.select("author", "title")).distinct()
