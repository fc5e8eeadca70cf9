"""Annotation, assembly of training sets and evaluation of detectors, as table work."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.files import dealt
from .geometry import central_box, inside, iou

_BOX = "struct<k:double,seq:long,x1:int,y1:int,x2:int,y2:int,confidence:double>"
_CORNERS = ("x1", "y1", "x2", "y2")


def qc_reason(metrics: DataFrame) -> DataFrame:
    """Why an image (width, height, laplacian_variance, std) is skipped, the first reason that holds; else null."""
    small = F.least("width", "height") < 480
    return metrics.withColumn("skip_reason", F.when(F.col("width").isNull(), "undecodable").when(small, "too_small").when(F.col("laplacian_variance") < 40, "blurry").when(F.col("std") < 12, "monochrome"))


def proposal_filter(boxes: DataFrame, least: float, image_area: float, most: int = 3) -> DataFrame:
    """Of each image and class the best boxes that are confident, and at least 3 % of the image."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    rank = F.row_number().over(W.partitionBy("image_id", "class_name").orderBy(F.desc("confidence"), "seq"))
    return boxes.filter((F.col("confidence") >= least) & (area >= 0.03 * image_area)).withColumn("rn", rank).filter(F.col("rn") <= most)


def merge_proposals(first: DataFrame, second: DataFrame, most: int = 3) -> DataFrame:
    """Boxes of two models: the first's, then the second's that agree with none of these (IoU 0.5), up to ``most``;
    agreed tells which were agreed on. The boxes of an image are a few."""
    one = lambda: F.struct((-F.col("confidence")).alias("k"), F.col("seq").cast("long").alias("seq"), *[F.col(c).cast("int").alias(c) for c in _CORNERS], "confidence")
    a = first.groupBy("image_id").agg(F.array_sort(F.collect_list(one())).alias("a"))
    b = second.groupBy("image_id").agg(F.array_sort(F.collect_list(one())).alias("b"))
    none = F.array().cast(f"array<{_BOX}>")
    rows = a.join(b, "image_id", "full").select("image_id", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    entry = lambda box, agreed, source: F.struct(box.alias("box"), agreed.alias("agreed"), F.lit(source).alias("source"))
    start = F.transform(F.slice("a", 1, most), lambda x: entry(x, F.lit(False), "first"))

    def step(acc: Column, x: Column) -> Column:
        hit = F.get(F.filter(F.transform(acc, lambda y, i: F.when(iou(x, y["box"]) >= 0.5, i)), lambda i: i.isNotNull()), 0)
        marked = F.transform(acc, lambda y, i: F.struct(y["box"].alias("box"), (y["agreed"] | (i == hit)).alias("agreed"), y["source"].alias("source")))
        return F.when(hit.isNotNull(), marked).when(F.size(acc) < most, F.concat(acc, F.array(entry(x, F.lit(False), "second")))).otherwise(acc)

    return rows.select("image_id", F.posexplode(F.aggregate("b", start, step)).alias("n", "m")).select("image_id", "n", "m.source", "m.agreed", *[F.col(f"m.box.{c}").alias(c) for c in (*_CORNERS, "confidence")])


def choose_label(packages: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """A label for each package: of the first model's boxes whose centre is inside, else of the second's, else the middle."""
    p = packages.select("image_id", *[F.col(c).alias(f"p{c}") for c in _CORNERS])
    box = {c: F.col(f"p{c}") for c in _CORNERS}

    def candidates(labels: DataFrame, source: int) -> DataFrame:
        hit = inside((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, box)
        large = (F.col("x2") - F.col("x1") >= 12) & (F.col("y2") - F.col("y1") >= 12)
        return labels.join(p, "image_id").filter(hit & large).select("image_id", F.lit(source).alias("source"), "seq", *_CORNERS, "confidence")

    both = candidates(first, 0).unionByName(candidates(second, 1))
    best = both.groupBy("image_id").agg(F.min_by(F.struct(*_CORNERS, "source"), F.struct("source", -F.col("confidence"), "seq")).alias("b"))
    middle = central_box(box)
    rows = p.join(best, "image_id", "left")
    return rows.select("image_id", F.when(F.col("b").isNull(), "central").when(F.col("b.source") == 0, "first").otherwise("second").alias("origin"), *[F.coalesce(F.col(f"b.{c}"), middle[c]).alias(c) for c in _CORNERS])


def image_entries(boxes: DataFrame) -> DataFrame:
    """Per image (boxes with agreed): how many boxes, the top confidence, and whether it is in the strict pool."""
    top = F.round(F.max("confidence"), 3)
    return boxes.groupBy("image_id").agg(F.count("*").alias("n_boxes"), top.alias("top_confidence"), F.bool_or("agreed").alias("agreed")).withColumn("strict", (F.col("top_confidence") >= 0.45) | F.col("agreed"))


def split_train_val(entries: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Every image to train or val; val takes the share of all, from the strict pool only, at least one if there is any:
    those of the smallest hashes with a seed.

    The first 16 bits of the hashes are counted to find where the share ends (at most 65,536 counts come to the driver);
    only the images of that one range are ordered.
    """
    h = F.xxhash64(F.lit(seed), "image_id")
    ranged = entries.withColumn("range", F.shiftright(h, 48))
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"), F.count_if("strict").alias("s")).orderBy("range").collect()
    left = min(max(1, int(sum(r["n"] for r in counts) * share)), sum(r["s"] for r in counts))
    cut = None
    for row in counts:
        cut = row["range"]
        if row["s"] >= left:
            break
        left -= row["s"]
    last = ranged.filter(F.col("strict") & (F.col("range") == F.lit(cut))).orderBy(h, "image_id").limit(left).select("image_id", F.lit(True).alias("v"))
    before = F.col("strict") & (F.col("range") < F.lit(cut))
    rows = ranged.join(last, "image_id", "left")
    return rows.withColumn("split", F.when(before | F.col("v"), "val").otherwise("train")).drop("v", "range")


def annotation_summary(entries: DataFrame, reasons: DataFrame) -> DataFrame:
    """Accepted images, rates of agreement and strictness, and what was skipped, by the first word of the reason."""
    n = F.count("*")
    rate = lambda c: F.when(n > 0, F.round(F.count_if(c) / n, 3)).otherwise(0.0)
    head = entries.agg(n.alias("accepted"), rate("agreed").alias("agreement_rate"), rate("strict").alias("strict_rate"))
    rows = head.select(F.explode(F.create_map(F.lit("accepted"), F.col("accepted").cast("double"), F.lit("agreement_rate"), "agreement_rate", F.lit("strict_rate"), "strict_rate")).alias("metric", "value"))
    skipped = reasons.filter("skip_reason is not null").groupBy(F.concat(F.lit("skipped_"), F.get(F.split("skip_reason", "_"), 0)).alias("metric")).agg(F.count("*").cast("double").alias("value"))
    return rows.unionByName(skipped)


def label_fallback_rate(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """The share of accepted images (entries) one of whose packages has no label found, but its middle (choose_label())."""
    fallback = labels.groupBy("image_id").agg(F.bool_or(F.col("origin") == "central").alias("f"))
    rows = entries.select("image_id").join(fallback, "image_id", "left")
    return rows.agg(F.lit("label_fallback_rate").alias("metric"), F.when(F.count("*") > 0, F.round(F.count_if("f") / F.count("*"), 3)).otherwise(0.0).alias("value"))


def combine_splits(synthetic: DataFrame, real: DataFrame, annotated: DataFrame, sample: int = 20, seed: int = 42, strict_only: bool = False) -> DataFrame:
    """Training and validation sets (image_id, pool, split) of two pools (image_id, split; real also strict).

    Train: all of both, of the real pool only the strict one if so asked. Val: all of the real one, and a seeded sample of
    the synthetic one. Images without an annotation are left out, sampled ones too.
    """
    one = lambda rows, pool, split: rows.select("image_id", F.lit(pool).alias("pool"), F.lit(split).alias("split"))
    train = real.filter("split = 'train'")
    parts = [
        one(synthetic.filter("split = 'train'"), "synthetic", "train"), one(train.filter("strict") if strict_only else train, "real", "train"),
        one(sample_images(synthetic.filter("split = 'val'"), sample, seed), "synthetic", "val"), one(real.filter("split = 'val'"), "real", "val"),
    ]
    return functools.reduce(DataFrame.unionByName, parts).join(annotated.select("image_id").distinct(), "image_id", "left_semi")


def combine_datasets(first: DataFrame, second: DataFrame, annotated: DataFrame, strict_only: bool = False) -> DataFrame:
    """Both pools, without images that have no annotation, and without those outside the strict pool if so asked."""
    rows = first.unionByName(second).join(annotated.select("image_id").distinct(), "image_id", "left_semi")
    return rows.filter("strict") if strict_only else rows


def sample_images(entries: DataFrame, n: int = 20, seed: int = 42) -> DataFrame:
    """A sample that a repeated run takes again."""
    return entries.orderBy(F.xxhash64(F.lit(seed), "image_id"), "image_id").limit(n)


def match_predictions(predictions: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """Predictions as true or false positives: by falling confidence each takes the best truth box that is still free, the
    first of equals, if the IoU is at least ``least``."""
    one = F.struct((-F.col("confidence")).alias("k"), F.col("seq").cast("long").alias("seq"), *[F.col(c).cast("int").alias(c) for c in _CORNERS], "confidence")
    p = predictions.groupBy("image_id", "class_name").agg(F.array_sort(F.collect_list(one)).alias("ps"))
    t = truth.groupBy("image_id", "class_name").agg(F.array_sort(F.collect_list(F.struct("seq", *_CORNERS))).alias("ts"))
    state = "struct<used:array<int>,out:array<struct<seq:long,confidence:double,tp:boolean>>>"
    rows = p.join(t, ["image_id", "class_name"], "left")

    def step(acc: Column, x: Column) -> Column:
        free = F.filter(F.transform(F.coalesce("ts", F.array().cast("array<struct<seq:long,x1:int,y1:int,x2:int,y2:int>>")), lambda y, i: F.struct((-iou(x, y)).alias("k"), i.alias("i"))), lambda c: ~F.array_contains(acc["used"], c["i"]))
        best = F.array_min(free)
        hit = F.coalesce(-best["k"] >= least, F.lit(False))
        used = F.when(hit, F.concat(acc["used"], F.array(best["i"]))).otherwise(acc["used"])
        return F.struct(used.alias("used"), F.concat(acc["out"], F.array(F.struct(x["seq"].alias("seq"), x["confidence"].alias("confidence"), hit.alias("tp")))).alias("out"))

    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<seq:long,confidence:double,tp:boolean>>").alias("out")).cast(state)
    return rows.select("image_id", "class_name", F.explode(F.aggregate("ps", start, step)["out"]).alias("o")).select("image_id", "class_name", "o.seq", "o.confidence", "o.tp")


#: Rows of a class's curve that one window holds, about; the sampled rows that a cut between windows is taken from.
EACH, SAMPLED = 100_000, 50


def in_ranges(rows: DataFrame, key: Column, each: int = EACH) -> DataFrame:
    """``rows`` with ``range``, a number that grows with ``key`` and stands on some ``each`` rows, unless they are equal in
    all of key. Cuts are taken from a seeded sample, SAMPLED rows of each range, of which the cuts come to the driver."""
    n = rows.count()
    if n <= each:
        return rows.withColumn("range", F.lit(0))
    sample = rows.select(key.alias("k")).sample(min(1.0, SAMPLED / each), seed=42)
    cuts = sample.agg(F.filter(F.array_sort(F.collect_list("k")), lambda k, i: (i > 0) & (i % SAMPLED == 0)).alias("cuts"))
    cuts = rows.sparkSession.createDataFrame([(cuts.first()["cuts"],)], cuts.schema)
    rows = rows.withColumn("__k", key).withColumn("range", F.lit(0)).crossJoin(F.broadcast(cuts))
    # how many cuts aren't above the key, by halving
    for step in (1 << k for k in reversed(range((n // each).bit_length() + 1))):
        rows = rows.withColumn("range", F.when(F.get("cuts", F.col("range") + (step - 1)) <= F.col("__k"), F.col("range") + step).otherwise(F.col("range")))
    return rows.drop("__k", "cuts")


def average_precision(matches: DataFrame, truth: DataFrame, chunks: int = 1000, each: int = EACH) -> DataFrame:
    """Per class the area under the envelope of precision over recall; null without truth.

    The curve of a class has a point for each prediction, by falling confidence, image and seq. Windows hold what falls
    into one range of confidence, and of that what in_ranges() puts together of ``each`` rows, however many predictions are
    alike: predictions are cut into ``chunks`` ranges of confidence and these by their order, numbered inside, and shifted by
    the counts of the ranges before; the envelope is the best precision further on in the range or in the ranges after.
    """
    range_ = F.coalesce(F.floor(F.col("confidence") * -chunks), F.lit(1 << 40)).alias("chunk")
    rows = matches.select("class_name", "image_id", "seq", "confidence", F.col("tp").cast("int").alias("tp"), range_)
    # as the windows order them: null last
    rows = in_ranges(rows, F.struct(F.col("confidence").isNull().alias("none"), (-F.col("confidence")).alias("c"), F.col("image_id").alias("i"), F.col("seq").alias("s")), each)
    group = ["class_name", "chunk", "range"]
    inner = W.partitionBy(*group)
    until = inner.orderBy(F.desc("confidence"), "image_id", "seq").rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy("class_name").orderBy("chunk", "range").rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy("class_name").orderBy(F.desc("chunk"), F.desc("range")).rowsBetween(W.unboundedPreceding, -1)

    sums = rows.groupBy(*group).agg(F.sum("tp").alias("s"), F.count("*").alias("k"))
    shift = sums.select(*group, F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s0"), F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("k0"))
    rows = dealt(rows, *group)
    rows = rows.withColumn("tps", F.sum("tp").over(until)).withColumn("n", F.count("*").over(until)).join(shift, group)
    rows = rows.select(*group, "n", "tp", ((F.col("s0") + F.col("tps")) / (F.col("k0") + F.col("n"))).alias("precision"))
    tops = rows.groupBy(*group).agg(F.max("precision").alias("top"))
    tops = tops.select(*group, F.max("top").over(later).alias("top"))
    onward = F.max("precision").over(inner.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("onward", onward).filter("tp = 1").join(tops, group)
    # each true positive moves the recall on by 1 / n_truth
    area = rows.groupBy("class_name").agg(F.sum(F.greatest("onward", "top")).alias("area"))
    total = truth.groupBy("class_name").agg(F.count("*").alias("n_truth"))
    names = matches.select("class_name").union(truth.select("class_name")).distinct()
    ap = F.when(F.col("n_truth") > 0, F.round(F.coalesce("area", F.lit(0.0)) / F.col("n_truth"), 3)).alias("ap50")
    return names.join(total, "class_name", "left").join(area, "class_name", "left").select("class_name", F.coalesce("n_truth", F.lit(0)).alias("n_truth"), ap)


def mean_ap(ap: DataFrame) -> DataFrame:
    return ap.agg(F.round(F.avg("ap50"), 3).alias("map50"), F.count("ap50").alias("n_classes"), F.sum("n_truth").alias("n_truth"))
