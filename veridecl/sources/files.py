"""Text annotations, images and other files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by their keys over all shuffle partitions: with a number of them Spark doesn't put small ones together,
    and many rows may be small as a shuffle writes them and large where they are sorted or grouped."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def image_id(path: Column) -> Column:
    """The image that a file is of: the value of its folder ``image_id=...``, else its name up to the last point."""
    # a plus stands for itself
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    folder = F.regexp_extract(path, r"/image_id=([^/]+)/[^/]*$", 1)
    name = F.regexp_extract(path, r"([^/]*?)(?:\.[^/.]*)?$", 1)
    # paths are written with %XX, and in folders' names some characters are already
    return F.when(folder != "", plain(plain(folder))).otherwise(plain(name))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images of a folder and the folders ``image_id=...`` in it, with height, width, channels and BGR bytes; what can't be
    decoded is left out. image_id() of image.origin tells which image it is."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image")


def encode_bmp(pixels: Column, width: Column, height: Column) -> Column:
    """Grey pixels (binary, by rows from the top; the width a multiple of four) as an image file, by column functions."""
    def word(n: Column) -> Column:
        h = F.lpad(F.hex(n.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
        return F.unhex(F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)]))

    greys = b"".join(bytes((g, g, g, 0)) for g in range(256))
    at = 14 + 40 + len(greys)
    size = F.octet_length(pixels)
    head = [F.lit(b"BM"), word(size + at), word(F.lit(0)), word(F.lit(at)), word(F.lit(40)), word(width), word(-height), F.lit(b"\x01\x00\x08\x00"), word(F.lit(0)), word(size)]
    return F.concat(*head, word(F.lit(0)), word(F.lit(0)), word(F.lit(256)), word(F.lit(0)), F.lit(greys), pixels)


def write_images(images: DataFrame, path: str) -> None:
    """Rows (image_id, content) as one file each, in a folder ``image_id=...``; a line feed follows the content."""
    images.select(F.col("image_id").cast("string").alias("image_id"), F.col("content").cast("string").alias("value")).write.partitionBy("image_id").text(path)


def parse_yolo_lines(lines: DataFrame, dims: DataFrame) -> DataFrame:
    """Lines (image_id, value) ``class xc yc w h``, as shares of the image's width and height (dims), as pixel boxes;
    lines without five fields are dropped. Boxes are dealt by image, so that what groups them by image and more shuffles
    nothing, and holds no groups where the lines are read."""
    parts = lines.withColumn("p", F.split(F.trim("value"), r"\s+")).filter(F.size("p") == 5)
    rows = dealt(parts.select("image_id", F.get("p", 0).cast("int").alias("cls"), *[F.get("p", k + 1).cast("double").alias(n) for k, n in enumerate(("xc", "yc", "bw", "bh"))]), "image_id").join(dims, "image_id")
    edge = lambda c, size, of, sign: F.floor(F.expr(f"({c} {sign} {size} / 2) * {of}") + 0.5).cast("int")
    return rows.select("image_id", "cls", edge("xc", "bw", "width", "-").alias("x1"), edge("yc", "bh", "height", "-").alias("y1"), edge("xc", "bw", "width", "+").alias("x2"), edge("yc", "bh", "height", "+").alias("y2"))


def read_yolo_labels(spark: SparkSession, path: str, dims: DataFrame) -> DataFrame:
    """Annotation files of a folder and those in it, named by image or in folders ``image_id=...`` (see image_id()), as
    pixel boxes; image_id is a string."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(image_id(F.col("_metadata.file_path")).alias("image_id"), "value")
    return parse_yolo_lines(lines, dims.withColumn("image_id", F.col("image_id").cast("string")))


def yolo_lines(boxes: DataFrame) -> DataFrame:
    """Boxes (image_id, seq, class_name, corners, width, height) as annotation lines, package 0 and label 1."""
    cls = F.when(F.col("class_name") == "package", 0).otherwise(1)
    share = lambda a, b, of, half: (F.col(b) + F.col(a) if half else F.col(b) - F.col(a)) / (2.0 if half else 1.0) / F.col(of)
    line = F.format_string("%d %.6f %.6f %.6f %.6f", cls, share("x1", "x2", "width", True), share("y1", "y2", "height", True), share("x1", "x2", "width", False), share("y1", "y2", "height", False))
    return boxes.select("image_id", F.col("seq"), line.alias("value"))


def write_yolo_labels(boxes: DataFrame, path: str) -> None:
    """One file for each image, in a folder ``image_id=...``, with its lines by seq."""
    lines = dealt(yolo_lines(boxes), "image_id").sortWithinPartitions("image_id", "seq")
    lines.select("image_id", "value").write.mode("overwrite").partitionBy("image_id").text(path)
