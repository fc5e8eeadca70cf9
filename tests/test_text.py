from pyspark.sql import functions as F

from veridecl.functions import text as t
from veridecl.operators import compliance, geometry


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("x")).first()["x"]


def test_fix_ocr(spark):
    assert [one(spark, s, t.fix_ocr) for s in ("5O0gm", "5l0gm", "Product Name")] == ["500gm", "510gm", "Product Name"]


def test_units(spark):
    cases = {"500gm": ("g", "500"), "250gram": ("g", "250"), "330ml": ("ml", "330"), "2kg": ("kg", "2"), "1.5ltr": ("l", "1.5"), "10pcs": ("pcs", "10"), "500xyz": (None, "500xyz"), "999": (None, "999")}
    assert {s: tuple(one(spark, s, t.normalize_unit)) for s in cases} == cases


def test_currency(spark):
    assert [one(spark, s, t.normalize_currency)["currency"] for s in ("Rs. 999", "Rs.1499", "INR 599", "₹999", "500gm", "Refined")] == ["INR", "INR", "INR", "INR", None, "INR"]


def test_month(spark):
    cases = {"08/2026": (8, 2026), "12-2025": (12, 2025), "01.2027": (1, 2027), "15/08/2026": (8, 2026), "not a date": None, "13/2026": None, "08/2019": None}
    assert {s: (lambda d: d and tuple(d))(one(spark, s, t.parse_month)) for s in cases} == cases


def test_language(spark):
    assert [one(spark, s, t.detect_language) for s in ("भारत", "made", "भारत is a very long text", "")] == ["hi", "en", "en", "unknown"]


def test_severity(spark):
    rows = spark.createDataFrame([("mrp", "MISSING"), ("x", "MISSING"), ("mrp", "FORMAT"), ("x", "FORMAT"), (None, "PRESENCE")], "f string, t string")
    assert [r[0] for r in rows.select(compliance.severity(F.col("f"), F.col("t"))).collect()] == ["critical", "major", "major", "minor", "minor"]


def test_nms_against_plain_loop(spark):
    import random

    random.seed(3)
    rows = []
    for i in range(30):
        for s in range(12):
            x, y = random.randrange(40), random.randrange(40)
            rows.append((i, s, "package", x, y, x + 20, y + 20, random.randrange(5) / 4))
    df = spark.createDataFrame(rows, "image_id int, seq long, class_name string, x1 int, y1 int, x2 int, y2 int, confidence double")
    got = {(r["image_id"], r["seq"]) for r in geometry.nms(df).collect()}

    def iou(a, b):
        w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
        both = max(0, w) * max(0, h)
        return both / (800 - both)

    want = set()
    for i in range(30):
        kept = []
        for r in sorted((r for r in rows if r[0] == i), key=lambda r: (-r[7], r[1])):
            if all(iou(r, k) <= 0.45 for k in kept):
                kept.append(r)
        want |= {(i, r[1]) for r in kept}
    assert got == want
