"""Greedy steps over boxes and the assembly of sets, against plain loops."""

import random

from pyspark.sql import functions as F

from veridecl.operators import dataset, geometry

BOX = "image_id long, class_name string, seq long, x1 int, y1 int, x2 int, y2 int, confidence double"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0, w) * max(0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0


def some_boxes(rng, images=25, classes=("package", "label"), many=9):
    rows = []
    for i in range(images):
        for c in classes:
            for k in range(rng.randrange(many)):
                x, y = rng.randrange(40), rng.randrange(40)
                rows.append((i, c, k, x, y, x + rng.randrange(0, 60), y + rng.randrange(1, 50), rng.choice([0.2, 0.5, 0.5, 0.7, 0.9])))
    return rows


def by(rows, *keys):
    out = {}
    for r in rows:
        out.setdefault(tuple(r[k] for k in keys), []).append(r)
    return out


def greedy(rows, overlap):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[7], r[2])):
        if all(iou(r[3:7], k[3:7]) <= overlap for k in kept):
            kept.append(r)
    return kept


def test_suppression_and_label_boxes(spark):
    rows = some_boxes(random.Random(1))
    df = spark.createDataFrame(rows, BOX)
    got = sorted((r.image_id, r.class_name, r.seq) for r in geometry.nms(df).collect())
    assert got == sorted(r[:3] for group in by(rows, 0, 1).values() for r in greedy(group, geometry.OVERLAP))
    images = spark.createDataFrame([(i, 120, 100) for i in range(27)], "image_id long, width int, height int")
    packages = geometry.package_boxes(images, df)
    found = {r.image_id: r for r in packages.collect()}
    groups = by(rows, 0, 1)
    want = []
    for i in range(27):
        best = [r for r in greedy(groups.get((i, "package"), []), geometry.OVERLAP) if r[7] >= geometry.PACKAGE_CONFIDENCE]
        p = best[0][3:7] if best else (0, 0, 120, 100)
        assert tuple(found[i][c] for c in ("x1", "y1", "x2", "y2")) == p and found[i].manual_crop_used == (not best)
        cut = []
        for r in groups.get((i, "label"), []):
            x1, y1, x2, y2 = (max(min(r[3 + k], p[2 + k % 2]), p[k % 2]) for k in range(4))
            if x2 > x1 and y2 > y1:
                cut.append((*r[:3], x1, y1, x2, y2, r[7]))
        want += [(i, *r[2:7], r[7]) for r in greedy(cut, geometry.OVERLAP)] or [(i, -1, *p, 0.4)]
    got = [tuple(r[c] for c in ("image_id", "seq", "x1", "y1", "x2", "y2", "confidence")) for r in geometry.label_boxes(packages, df).collect()]
    assert sorted(got) == sorted(want)


def test_merged_proposals(spark):
    rng = random.Random(2)
    a, b = some_boxes(rng, classes=("package",), many=6), some_boxes(rng, classes=("package",), many=6)
    got = {}
    for r in dataset.merge_proposals(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX)).orderBy("image_id", "n").collect():
        got.setdefault(r.image_id, []).append((r.source, r.agreed, (r.x1, r.y1, r.x2, r.y2)))
    first, second, want = by(a, 0), by(b, 0), {}
    order = lambda rows: sorted(rows, key=lambda r: (-r[7], r[2]))
    for i in range(25):
        merged = [["first", False, r[3:7]] for r in order(first.get((i,), []))[:3]]
        for r in order(second.get((i,), [])):
            hit = next((m for m in merged if iou(r[3:7], m[2]) >= 0.5), None)
            if hit:
                hit[1] = True
            elif len(merged) < 3:
                merged.append(["second", False, r[3:7]])
        if merged:
            want[i] = [tuple(m) for m in merged]
    assert got == want and any(m[1] for ms in want.values() for m in ms)


def test_matches_with_truth(spark):
    rng = random.Random(3)
    p, t = some_boxes(rng), some_boxes(rng)
    got = {(r.image_id, r.class_name, r.seq): r.tp for r in dataset.match_predictions(spark.createDataFrame(p, BOX), spark.createDataFrame(t, BOX)).collect()}
    truth, want = by(t, 0, 1), {}
    for key, rows in by(p, 0, 1).items():
        free = sorted(truth.get(key, []), key=lambda r: r[2])
        for r in sorted(rows, key=lambda r: (-r[7], r[2])):
            best = max(free, key=lambda f: iou(r[3:7], f[3:7]), default=None)
            hit = best is not None and iou(r[3:7], best[3:7]) >= 0.5
            if hit:
                free.remove(best)
            want[r[:3]] = hit
    assert got == want and any(want.values())


def test_combined_splits_and_fallback(spark):
    rows = [(i, "val" if i % 3 == 0 else "train", i % 4 == 0) for i in range(200)]
    pool = spark.createDataFrame(rows, "image_id long, split string, strict boolean")
    real = pool.withColumn("image_id", F.col("image_id") + 1000)
    annotated = spark.createDataFrame([(i,) for i in range(150)] + [(1000 + i,) for i in range(150)] * 2, "image_id long")
    ranked = [r.image_id for r in pool.filter("split = 'val'").orderBy(F.xxhash64(F.lit(42), "image_id"), "image_id").collect()][:20]
    want = [(i, "synthetic", "train") for i, s, _ in rows if s == "train" and i < 150] + [(i, "synthetic", "val") for i in ranked if i < 150]
    for strict in (False, True):
        both = want + [(1000 + i, "real", s) for i, s, k in rows if i < 150 and (s == "val" or k or not strict)]
        assert sorted(map(tuple, dataset.combine_splits(pool, real, annotated, strict_only=strict).collect())) == sorted(both)
    labels = spark.createDataFrame([(0, "first"), (0, "central"), (1, "second"), (2, "central"), (999, "central")], "image_id long, origin string")
    assert dataset.label_fallback_rate(pool.filter("image_id < 8"), labels).first().value == 0.25
    assert dataset.label_fallback_rate(pool.filter("image_id < 0"), labels).first().value == 0.0
