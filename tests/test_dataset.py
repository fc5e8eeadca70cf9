"""The split against sorting all images, and average precision against a loop."""

import random

import pytest
from pyspark.sql import functions as F

from veridecl.operators import dataset


def test_split_takes_the_smallest_hashes(spark):
    for n, share in ((0, 0.2), (1, 0.2), (7, 0.5), (400, 0.2), (400, 0.9)):
        entries = spark.createDataFrame([(f"img{i}", i % 3 != 0) for i in range(n)], "image_id string, strict boolean")
        got = {r.image_id for r in dataset.split_train_val(entries, share).filter("split = 'val'").collect()}
        ranked = [r.image_id for r in entries.filter("strict").orderBy(F.xxhash64(F.lit(42), "image_id"), "image_id").collect()]
        assert got == set(ranked[: max(1, int(n * share))])
        assert dataset.split_train_val(entries, share).count() == n


def test_a_curve_of_equal_confidences_is_cut(spark):
    rng = random.Random(3)
    rows = [("ab"[k % 2], rng.randrange(400), k, rng.choice([0.5, 0.5, 0.5, None, 0.9]), rng.random() < 0.4) for k in range(3000)]
    m = spark.createDataFrame(rows, "class_name string, image_id long, seq long, confidence double, tp boolean").persist()
    parts = dataset.in_ranges(m.filter("confidence = 0.5"), F.struct("image_id", "seq"), each=100)
    found = parts.groupBy("range").agg(F.count("*").alias("n"), F.min(F.struct("image_id", "seq")).alias("lo"), F.max(F.struct("image_id", "seq")).alias("hi")).orderBy("range").collect()
    assert len(found) > 5 and max(r.n for r in found) < 400 and sum(r.n for r in found) == m.filter("confidence = 0.5").count()
    assert all(a.hi < b.lo for a, b in zip(found, found[1:]))
    got = sorted(map(tuple, dataset.average_precision(m, m.filter("tp"), each=100).collect()))
    want = []
    for name in "ab":
        mine = sorted((r for r in rows if r[0] == name), key=lambda r: (r[3] is None, -(r[3] or 0), r[1], r[2]))
        n_truth, hits, points = sum(r[4] for r in mine), 0, []
        for k, r in enumerate(mine):
            hits += r[4]
            points.append((r[4], hits / (k + 1)))
        area, best = 0.0, 0.0
        for tp, precision in reversed(points):
            best = max(best, precision)
            area += best * tp
        want.append((name, n_truth, pytest.approx(area / n_truth, abs=0.00051)))
    assert got == want
