"""Files that are written and read again: entities with faults, annotations by image, and encoded images."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veridecl.operators import inspections
from veridecl.sources import checks, files, schemas


def write(spark, folder, name, rows, ddl):
    spark.createDataFrame(rows, ddl).write.parquet(f"{folder}/{name}.parquet")


def test_entities_with_faults(spark, tmp_path):
    folder = str(tmp_path)
    write(spark, folder, "users", [("1", "a", None, "admin", None, True, None), ("1", "b", None, "clerk", None, True, None), (None, "c", None, None, None, None, None)], schemas.SCHEMAS["users"])
    write(spark, folder, "categories", [("1", "Food", None), ("2", "Tea", "1"), ("3", "Odd", "9")], schemas.SCHEMAS["categories"])
    write(spark, folder, "products", [(5, "Tea", "2", "x"), (6, "Oil", "8", "x"), (6, "Oil", None, "x")], "id long, product_name string, category_id string, colour string")
    write(spark, folder, "reports", [], schemas.SCHEMAS["reports"])
    got = {(r.entity, r.issue, r.field): r.n for r in checks.check_entities(spark, folder).collect()}
    want = {(e, "missing_table", ""): 1 for e in schemas.SCHEMAS if e not in ("users", "categories", "products", "reports")}
    want |= {("users", "null_key", "id"): 1, ("users", "duplicate_key", "id"): 1, ("users", "bad_value", "role"): 1, ("categories", "orphan", "parent_id"): 1}
    want |= {("products", "type", "id"): 1, ("products", "unknown_column", "colour"): 1, ("products", "duplicate_key", "id"): 1, ("products", "orphan", "category_id"): 1}
    want |= {("products", "missing_column", c): 1 for c in ("barcode", "manufacturer_name", "previous_inspection_id", "created_at")}
    assert got == want


def test_keys_are_checked_without_joins(spark, tmp_path, capsys):
    # a table of many null columns looks small to the planner, so that joins broadcast its ids through the driver
    folder = str(tmp_path)
    null = lambda name: [f"cast(null as {f.dataType.simpleString()}) {f.name}" for f in StructType.fromDDL(schemas.SCHEMAS[name])]
    for name, ids in {"inspections": "cast(id as string) id", "violations": "cast(id % 20 as string) id"}.items():
        own = {"violations": ["cast(id + 5 as string) inspection_id"]}.get(name, [])
        named = [x.split()[-1] for x in (ids, *own)]
        spark.range(30).selectExpr(ids, *own, *[c for c in null(name) if c.split()[-1] not in named]).write.parquet(f"{folder}/{name}.parquet")
    found = checks.check_entities(spark, folder)
    found.explain()
    assert "Join" not in capsys.readouterr().out
    got = {(r.entity, r.issue, r.field): r.n for r in found.filter("issue <> 'missing_table'").collect()}
    assert got == {("violations", "duplicate_key", "id"): 10, ("violations", "orphan", "inspection_id"): 5}


def test_annotations_come_back(spark, tmp_path):
    rows = [("a b/c", 2, "label", 3, 4, 33, 44), ("a b/c", 1, "package", 0, 0, 120, 100), ("50%+x", 1, "label", 7, 8, 9, 10), ("7", 1, "label", 7, 8, 9, 10)]
    boxes = spark.createDataFrame(rows, "image_id string, seq long, class_name string, x1 int, y1 int, x2 int, y2 int").withColumn("width", F.lit(120)).withColumn("height", F.lit(100))
    files.write_yolo_labels(boxes.repartition(3), str(tmp_path / "l"))
    (tmp_path / "l" / "plain.name.txt").write_text("0 0.5 0.5 0.5 0.5\nbroken line\n")
    dims = boxes.select("image_id", "width", "height").distinct().unionByName(spark.createDataFrame([("plain.name", 100, 100)], "image_id string, width int, height int"))
    got = sorted(map(tuple, files.read_yolo_labels(spark, str(tmp_path / "l"), dims).collect()))
    assert got == sorted([(i, 0 if c == "package" else 1, *b) for i, _, c, *b in rows] + [("plain.name", 0, 25, 25, 75, 75)])
    one = [p for p in (tmp_path / "l").glob("image_id=a b*/*.txt")]
    assert len(one) == 1 and [x[0] for x in one[0].read_text().splitlines()] == ["0", "1"]  # by seq


def test_images_come_back(spark, tmp_path):
    rng = np.random.default_rng(5)
    pictures = {"x=1": rng.integers(0, 256, (6, 8)), "flat": np.full((1, 4), 255), "tall": rng.integers(0, 256, (300, 4))}
    rows = [(name, p.astype(np.uint8).tobytes(), p.shape[1], p.shape[0]) for name, p in pictures.items()]
    images = spark.createDataFrame(rows, "image_id string, pixels binary, w int, h int").select("image_id", files.encode_bmp(F.col("pixels"), F.col("w"), F.col("h")).alias("content"))
    files.write_images(images.unionByName(spark.createDataFrame([("bad", bytearray(b"BMno"))], "image_id string, content binary")), str(tmp_path / "i"))
    read = files.read_images(spark, str(tmp_path / "i"))
    got = {r.i: r for r in read.select(files.image_id(F.col("image.origin")).alias("i"), "image.*").collect()}
    assert sorted(got) == sorted(pictures)
    for name, p in pictures.items():
        data = np.frombuffer(got[name].data, np.uint8).reshape(got[name].height, got[name].width, got[name].nChannels)
        assert data.shape[:2] == p.shape and all((data[:, :, c] == p).all() for c in range(data.shape[2]))
    metrics = {r.i: r for r in inspections.pixel_metrics(read).withColumn("i", files.image_id(F.col("origin"))).collect()}
    for name, p in pictures.items():
        m = np.pad(p.astype(float), 1, mode="reflect")
        lap = m[:-2, 1:-1] + m[2:, 1:-1] + m[1:-1, :-2] + m[1:-1, 2:] - 4 * p
        assert metrics[name].laplacian_variance == pytest.approx(lap.var()) and metrics[name].bright_ratio == pytest.approx((p >= 240).mean())


def test_boxes_are_dealt_before_they_are_grouped(spark, capsys):
    lines = spark.range(300).selectExpr("id % 30 as image_id", "'0 0.5 0.5 0.5 0.' || (id % 3 + 1) as value")
    dims = spark.range(30).selectExpr("id as image_id", "100 as width", "100 as height")
    counts = files.parse_yolo_lines(lines, dims).groupBy("image_id", "cls", "x1", "y1", "x2", "y2").agg(F.count("*").alias("n"))
    counts.explain()
    # one shuffle of the lines with a number of partitions, which Spark doesn't put together, and none of the groups
    plan = capsys.readouterr().out
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(image_id#" in plan and ", cls#" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)
    assert counts.count() == 30 and counts.agg(F.sum("n")).first()[0] == 300
