"""Secret scanning with linking of credential parts, in DataFrame functions only."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Base kinds in their order: pattern, and the group whose length counts with its least length.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
#: Patterns that find what the base patterns find after short matches are dropped, where that can be said so: their
#: matches are maximal runs of a class of characters, so a short one hides no longer one.
DIRECT = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
#: Weak candidates: too common to be reported alone.
WEAK = {
    "key_id": r"""\b(?:AKIA|ASIA|(?i:access|client|account)[_-]?(?i:key|id)["']?\x20*[:=]\x20*["']?)[A-Za-z0-9_-]{4,}""",
    "key_secret": r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{20,}={0,2}",
    "endpoint": r"(?:https?|ftp|jdbc:[a-z]+|amqp|redis|mongodb)://[A-Za-z0-9._~:@%+-]+",
}
#: What a part can be of a credential.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "key_id": "id", "key_secret": "secret", "endpoint": "place"}
#: Characters between two parts of one credential at most.
SCOPE = 300
RANK = {kind: k for k, kind in enumerate([*BASE, *WEAK])}


def _kind_value(values: dict, kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[kind]


def _matches(texts: DataFrame, kind: str) -> DataFrame:
    """Rows (digest, kind, start, end) of the non-overlapping matches of one kind, from the left, in code points.

    A split at the pattern gives what lies between the matches, so that a match starts where the lengths of all before
    it add up. Only texts with a match are split; equal texts count once. Each kind has its own scan, with a filter that
    is compiled: one scan that looks for all kinds takes half as long again.
    """
    pattern = DIRECT.get(kind) or (BASE[kind][0] if kind in BASE else WEAK[kind])
    group = BASE[kind][1] if kind in BASE else 0
    least = BASE[kind][2] if kind in BASE else 0
    text, regex = F.col("text"), F.lit(pattern)
    lengths = lambda values: F.transform(values, F.length)
    found = F.arrays_zip(
        lengths(F.split(text, pattern, -1)).alias("gap"), lengths(F.regexp_extract_all(text, regex, F.lit(0))).alias("all"), lengths(F.regexp_extract_all(text, regex, F.lit(group))).alias("part")
    )
    rows = texts.filter(text.rlike(pattern)).select("digest", F.posexplode(found).alias("n", "m"))
    rows = rows.select("digest", "n", "m.gap", "m.all", "m.part").filter("all is not null").dropDuplicates(["digest", "n"])
    before = W.partitionBy("digest").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("all")).over(before))
    return rows.filter(F.col("part") >= least).select("digest", F.lit(kind).alias("kind"), (F.col("end") - F.col("all")).alias("start"), "end")


def _outside_base(parts: DataFrame) -> DataFrame:
    """Without the weak parts that lie inside one base span."""
    base = F.col("kind").isin(*BASE)
    so_far = W.partitionBy("digest").orderBy("start").rangeBetween(W.unboundedPreceding, W.currentRow)
    reach = F.max(F.when(base, F.col("end"))).over(so_far)
    return parts.withColumn("reach", reach).filter(base | F.col("reach").isNull() | (F.col("reach") < F.col("end"))).drop("reach")


def _linked(parts: DataFrame) -> DataFrame:
    """The weak parts with a part of another role within SCOPE characters in the same text; an endpoint counts only
    beside a secret or an identifier, and shows neither.

    A part beside a weak one ends at most SCOPE characters before it or starts at most so many after it, so only those
    two points are looked up, whatever the lengths of both: points are put in bins of SCOPE characters, and a weak part
    looks into the bin of its start and the one before, and into the bin of its end and the one after. The pairs looked
    at are bounded by what a few hundred characters can hold.
    """
    parts = parts.withColumn("role", _kind_value(ROLE, F.col("kind")))
    cell = lambda c: F.floor(F.col(c) / SCOPE)
    key = lambda side, cell: F.struct(F.lit(side).alias("side"), cell.alias("bin"))
    looks = F.array(key("before", cell("start") - 1), key("before", cell("start")), key("after", cell("end")), key("after", cell("end") + 1))
    weak = parts.filter(F.col("kind").isin(*WEAK)).select("*", F.inline(looks))
    points = F.array(key("before", cell("end")), key("after", cell("start")))
    near = parts.filter("role <> 'place'").select(F.col("digest").alias("d"), F.col("role").alias("r"), F.col("start").alias("s"), F.col("end").alias("e"), F.inline(points).alias("at", "b"))
    w, n = weak.alias("w"), near.alias("n")
    gap = F.when(F.col("w.side") == "before", F.col("w.start") - F.col("n.e")).otherwise(F.col("n.s") - F.col("w.end"))
    beside = (F.col("w.digest") == F.col("n.d")) & (F.col("w.side") == F.col("n.at")) & (F.col("w.bin") == F.col("n.b")) & (F.col("w.role") != F.col("n.r")) & gap.between(0, SCOPE)
    return w.join(n, beside, "left_semi").select("digest", "kind", "start", "end").distinct()


def secret_spans(documents: DataFrame) -> DataFrame:
    """Rows (digest, kind, start, end, base) of the secrets in each distinct text; digest: SHA-256 of the text.

    Positions are code points, the end exclusive. Weak candidates that lie inside a base span are left out: that span
    stands for them, beside other parts too.
    """
    texts = documents.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
    found = [_matches(texts, kind) for kind in RANK]
    parts = _outside_base(functools.reduce(DataFrame.unionByName, found))
    base = F.col("kind").isin(*BASE)
    weak = _linked(parts)
    return parts.filter(base).withColumn("base", F.lit(True)).unionByName(weak.withColumn("base", F.lit(False)))


def scan(documents: DataFrame) -> DataFrame:
    """One row for each row of ``documents``: its secrets.

    Base spans are the leftmost non-overlapping matches of each kind in BASE, without those that are too short. The
    method adds weak candidates (WEAK) where complementary parts, an identifier and a secret, or an endpoint and one of
    these, lie within SCOPE characters. Returns doc_id, n_assign, n_access, n_hex, base_sha256 (of kind:start:end by
    start, then kind, comma-joined), spans (all spans, joined likewise), n_linked.

    Null texts are empty; those and texts without a secret have counts of 0 and the digest of the empty string.
    Repeated rows get equal results, a null doc_id stays null, and further columns are ignored. Each text is judged
    whole; only its matches are shuffled, and equal texts are judged once.
    """
    item = F.concat_ws(":", F.col("x.kind"), F.col("x.start"), F.col("x.end"))
    rank = _kind_value(RANK, F.col("kind"))
    ordered = F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind", "base")))
    spelled = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.count_if(F.col("kind") == kind).alias(f"n_{kind}")
    found = secret_spans(documents).groupBy("digest").agg(*(count(k) for k in BASE), F.count_if(~F.col("base")).alias("n_linked"), ordered.alias("all"))
    found = found.select("digest", *(f"n_{k}" for k in BASE), "n_linked", spelled(F.filter("all", lambda x: x["base"])).alias("base"), spelled(F.col("all")).alias("spans"))
    rows = documents.select("doc_id", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("digest")).join(found, "digest", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.select("doc_id", *(zero(f"n_{k}") for k in BASE), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_linked"))


def redact(documents: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``documents`` with every span that scan() reports in a text replaced by ``mark``; n_chars follows the text.

    Overlapping spans are replaced as one. Only texts with a span are touched: null and empty texts stay as they are,
    and repeated rows are changed alike. All columns come back, whatever their names; an empty table gives no rows.
    """
    cover = W.partitionBy("digest").orderBy("start", "end")
    spans = secret_spans(documents).withColumn("before", F.max("end").over(cover.rowsBetween(W.unboundedPreceding, -1)))
    runs = spans.withColumn("run", F.count_if(F.col("before").isNull() | (F.col("start") > F.col("before"))).over(cover))
    merged = runs.groupBy("digest", "run").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    merged = merged.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("cuts"))
    text, cuts = F.col("d.text").cast("string"), F.col("m.cuts")
    rows = documents.alias("d").join(merged.alias("m"), F.sha2(F.coalesce(text, F.lit("")), 256) == F.col("m.digest"), "left")
    begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(cuts, k - 1)["e"])
    end = lambda k: F.when(k == F.size(cuts), F.length(text)).otherwise(F.get(cuts, k)["s"])
    between = F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda k: F.substring(text, begin(k).cast("int") + 1, (end(k) - begin(k)).cast("int")))
    clean = F.when(cuts.isNull(), F.col("d.text")).otherwise(F.array_join(between, mark))
    columns = []
    for name in documents.columns:
        own = F.col(f"d.`{name}`")
        if name == "text":
            own = clean
        elif name == "n_chars":
            own = F.when(cuts.isNull(), own).otherwise(F.length(clean)).cast(documents.schema["n_chars"].dataType)
        columns.append(own.alias(name))
    return rows.select(*columns)
