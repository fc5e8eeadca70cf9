"""Versioned rules: which apply to an inspection on its date, and their verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.schemas import CONTENT

#: The keys that rules for all categories are joined by, and that no rule has; the keys of categories begin with another mark.
ANY, NONE, ONE = "*", "-", "="
#: Rules are broadcast up to so many bytes, as JSON; the join is the same beyond.
MOST_BROADCAST = 8 << 20
#: Parts that the time of the rules is cut into at most.
DATE_PARTS = 64
#: Versions of a rule, in the order of their start, that others meet at once when overlaps are sought.
NUMBERS = 64
FLAT = ("rule_version_id", "rule_key", "version", "effective_date", "end_date", "is_published", "product_categories", "exclude_categories", "package_type", "validation_type", "field", "pattern", "must_contain")

# The seeded rules, effective from 2020-01-01, for retail packages of all categories but industrial ones.
SEED_RULES = [
    ("MRP", "regex_and_presence", "mrp", r"(Rs\.?|₹|INR)\s*\d+", ["inclusive of all taxes"]),
    ("NET_QUANTITY", "presence_only", "net_quantity", None, None),
    ("MANUFACTURER", "presence_only", "manufacturer_name", None, None),
    ("MFG_DATE", "presence_only", "mfg_date", None, None),
    ("CONSUMER_CARE", "presence_only", "consumer_care", None, None),
]


def seed_rules(spark: SparkSession) -> DataFrame:
    rows = [(f"seed-{n}", key, 1, None, True, ["ALL"], ["Industrial/Bulk"], "retail", kind, field, pattern, must) for n, (key, kind, field, pattern, must) in enumerate(SEED_RULES)]
    df = spark.createDataFrame(rows, "rule_version_id string, rule_key string, version int, end_date date, is_published boolean, product_categories array<string>, exclude_categories array<string>, package_type string, validation_type string, field string, pattern string, must_contain array<string>")
    return df.withColumn("effective_date", F.lit("2020-01-01").cast("date")).select(*FLAT)


def load_rules(rules: DataFrame, versions: DataFrame) -> DataFrame:
    """Rule versions with their content parsed; keys that the JSON lacks are null."""
    c = F.from_json("content", CONTENT)
    rows = versions.withColumn("c", c).join(rules.select(F.col("id").alias("rule_id"), "rule_key", "title"), "rule_id")
    field = F.coalesce(F.nullif(F.col("c.validation.field"), F.lit("")), F.col("c.required_field"), F.lit(""))
    kind = F.when(F.col("c.validation").isNotNull(), F.coalesce("c.validation.type", F.lit("presence_only")))
    return rows.select(
        F.col("id").alias("rule_version_id"), "rule_key", "version", "effective_date", "end_date", F.col("published_at").isNotNull().alias("is_published"), F.col("c.applies_when.product_categories").alias("product_categories"),
        F.col("c.applies_when.exclude_categories").alias("exclude_categories"), F.col("c.applies_when.package_type").alias("package_type"), kind.alias("validation_type"), field.alias("field"), F.col("c.validation.pattern").alias("pattern"), F.col("c.validation.must_contain").alias("must_contain"),
    )


def target_field(content: Column) -> Column:
    """The field that a rule looks at: validation.field, else required_field, else empty."""
    return F.coalesce(F.nullif(content["validation"]["field"], F.lit("")), content["required_field"], F.lit(""))


def _matches(category: Column, required: Column, suffix: bool) -> Column:
    def one(c: Column) -> Column:
        hit = (category == c) | category.startswith(F.concat(c, F.lit(" >"))) | category.contains(F.concat(F.lit(" > "), c, F.lit(" > ")))
        return hit | category.endswith(F.concat(F.lit(" > "), c)) if suffix else hit

    free = required.isNull() | (F.size(required) == 0) | F.array_contains(required, "ALL")
    return F.coalesce(free | F.exists(required, one), F.lit(False))


def category_selected(category: Column, required: Column) -> Column:
    """Whether a rule is selected for a category: equal, or a prefix, suffix or inner part of its path."""
    return _matches(category, required, suffix=True)


def category_applies(category: Column, required: Column) -> Column:
    """Whether a selected rule applies: as category_selected(), without the suffix."""
    return _matches(category, required, suffix=False)


def applies_when_gate(category: Column, package_type: Column) -> Column:
    """Why a rule doesn't apply (category, excluded, package), the first reason that holds; else null."""
    excluded = F.coalesce(F.array_contains("exclude_categories", category), F.lit(False))
    wanted = F.col("rule_package_type")
    return F.when(~category_applies(category, F.col("product_categories")), "category").when(excluded, "excluded").when((F.coalesce(wanted, F.lit("")) != "") & ~package_type.eqNullSafe(wanted), "package")


def category_keys(category: Column) -> Column:
    """All required categories that category_selected() can find in a path, and ANY: its runs of parts, and its beginnings."""
    parts, marks = F.split(category, " > "), F.split(category, " >")
    runs = lambda i: F.transform(F.sequence(F.lit(1), F.size(parts) - i), lambda n: F.array_join(F.slice(parts, i + 1, n), " > "))
    inner = F.flatten(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), runs))
    begins = F.transform(F.sequence(F.lit(1), F.size(marks)), lambda n: F.array_join(F.slice(marks, F.lit(1), n), " >"))
    # no path of the usual two parts needs the general way
    few = F.array_compact(F.array(category, F.get(parts, 0), F.get(parts, 1), F.get(marks, 0)))
    named = F.when((F.size(parts) <= 2) & (F.size(marks) <= 2), few).otherwise(F.concat(inner, begins))
    keys = F.transform(F.array_distinct(named), lambda c: F.concat(F.lit(ONE), c))
    return F.when(category.isNull(), F.array(F.lit(ANY))).otherwise(F.concat(F.array(F.lit(ANY)), keys))


def small(rows: DataFrame) -> DataFrame:
    """The rows to be broadcast, if their size as JSON allows it; as they are else."""
    size = rows.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(rows) if size <= MOST_BROADCAST else rows


def matching_rules(rows: DataFrame, rules: DataFrame, match: Callable[[Column, Column], Column] = category_selected, on: tuple[str, ...] = (), spare: bool = False) -> DataFrame:
    """``rows`` (category and more) with each of ``rules`` (product_categories and more) for which match() holds.

    An equi-join by category, at every size: a rule has a row for each category that it requires, or one for ANY, and a
    row of ``rows`` one for each category that its path holds. A rule that is met by several of its categories is taken by
    the first of them. ``on``: further columns that must be equal. Rules are broadcast if their size allows it. With
    ``spare``, each row comes once more, without a rule.
    """
    required = F.coalesce("product_categories", F.array().cast("array<string>"))
    free = (F.size(required) == 0) | F.array_contains(required, "ALL")
    named = F.transform(F.array_distinct(required), lambda c: F.concat(F.lit(ONE), c))
    r = small(rules.withColumn("key", F.explode(F.when(free, F.array(F.lit(ANY))).otherwise(named))))
    # keys are never empty; a plain explode() would test that, working them out twice
    looked = rows.withColumn("keys", category_keys(F.col("category")))
    looked = looked.withColumn("key", F.explode_outer(F.concat(F.array(F.lit(NONE)), F.col("keys")) if spare else F.col("keys")))
    own = F.get(F.filter("product_categories", lambda c: F.array_contains(F.col("keys"), F.concat(F.lit(ONE), c)) & match(F.col("category"), F.array(c))), 0)
    # keys are what category_selected() finds, so that nothing is left to be tested of a rule's only category
    sure = F.size("product_categories") == 1 if match is category_selected else F.lit(False)
    hit = (F.col("key") == ANY) | sure | (F.col("key") == F.concat(F.lit(ONE), own))
    if spare:
        return looked.join(r, ["key", *on], "left").filter(F.col("rule_version_id").isNotNull() & hit | (F.col("key") == NONE)).drop("key", "keys")
    return looked.join(r, ["key", *on]).filter(hit).drop("key", "keys")


def time_parts(rules: DataFrame) -> tuple[DataFrame, Callable[[Column], Column]]:
    """Rules with a row for each ``part`` of time in which they are in force, and the part of a day; null before the first.

    The time from the first effective_date to the last is cut into DATE_PARTS equal parts at most, the last one without
    an end: after it no rule begins. A day lies in one part, so inspections don't grow, and meet only rules of that part.
    """
    first, last = rules.agg(F.min("effective_date"), F.max("effective_date")).first()  # rules are few
    if first is None:
        return rules.withColumn("part", F.lit(0)).filter(F.lit(False)), lambda day: F.lit(None).cast("int")
    width = (last - first).days // DATE_PARTS + 1
    most = (last - first).days // width
    part = lambda day: F.least(F.floor(F.date_diff(day, F.lit(first)) / width), F.lit(most)).cast("int")
    open_ = rules.filter(F.col("end_date").isNull() | (F.col("end_date") > F.col("effective_date"))).filter("effective_date is not null")
    to = F.when(F.col("end_date").isNull(), most).otherwise(part(F.date_sub("end_date", 1)))
    return open_.withColumn("part", F.explode(F.sequence(part(F.col("effective_date")), to))), lambda day: F.when(day >= F.lit(first), part(day))


def applicable_rules(inspections: DataFrame, rules: DataFrame, published_only: bool = False, spare: bool = False) -> DataFrame:
    """Rows of inspections (id, category, package_type, day) with each rule in force on the day that is selected for the
    category; rule_order is by effective_date, then version and id.

    An equi-join by category and part of time (matching_rules(), time_parts()), whatever the number of rules; the dates
    are tested on what it brings together. With ``spare``, each inspection has one more row, without a rule.
    """
    rules = rules.filter("is_published") if published_only else rules
    r, part = time_parts(rules.select(*[F.col(c).alias("rule_package_type" if c == "package_type" else c) for c in FLAT]))
    joined = matching_rules(inspections.withColumn("part", part(F.col("day"))), r, on=("part",), spare=spare)
    in_force = (F.col("effective_date") <= F.col("day")) & (F.col("end_date").isNull() | (F.col("end_date") > F.col("day")))
    order = F.row_number().over(W.partitionBy("id").orderBy("effective_date", "version", "rule_version_id"))
    kept = in_force | F.col("rule_version_id").isNull() if spare else in_force
    return joined.filter(kept).drop("part").withColumn("rule_order", order)


def best_declaration(declarations: DataFrame) -> DataFrame:
    """Of each inspection and field the declaration of the highest confidence (null is 0), the first of equals by ord."""
    best = F.min_by(F.struct("text", "confidence", "ord"), F.struct(-F.coalesce("confidence", F.lit(0.0)), F.col("ord")))
    return declarations.groupBy("inspection_id", "field_type").agg(best.alias("b")).select("inspection_id", "field_type", "b.text", "b.confidence", "b.ord")


def evaluate_rules(inspections: DataFrame, rules: DataFrame, declarations: DataFrame) -> DataFrame:
    """One verdict for each inspection and applicable rule version, with type and detail.

    An inspection's declarations (tens) are gathered into its row, best first as in best_declaration(), before it meets the
    rules: then all that follows is by inspection, and rows with rules aren't shuffled where these are broadcast.
    """
    said = F.array_sort(F.collect_list(F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("k"), "ord", "field_type", "text")))
    gathered = declarations.groupBy(F.col("inspection_id").alias("id")).agg(F.transform(said, lambda x: F.struct(x["field_type"].alias("field_type"), x["text"].alias("text"))).alias("said"))
    rows = applicable_rules(inspections.join(gathered, "id", "left"), rules)
    return verdicts(rows.withColumn("text", F.get(F.filter("said", lambda x: x["field_type"] == F.col("field")), 0)["text"]))


def verdicts(rows: DataFrame, *also: str) -> DataFrame:
    """The verdict on each row of applicable_rules() with the text of the declaration that its rule looks at; ``also``
    names columns that are handed on. A row without a rule has no verdict."""
    rows = rows.withColumn("gate", applies_when_gate(F.col("category"), F.col("package_type")))
    text, field, kind = F.col("text"), F.col("field"), F.col("validation_type")
    missing = text.isNull()
    unmatched = (F.coalesce("pattern", F.lit("")) != "") & ~F.rlike(text, F.col("pattern"))
    lacking = F.get(F.filter(F.coalesce("must_contain", F.array().cast("array<string>")), lambda x: ~text.contains(x)), 0)
    both, only, form = kind == "regex_and_presence", kind == "presence_only", kind == "format_check"
    cases = [
        (F.col("gate").isNotNull(), "NOT_APPLICABLE", "NOT_APPLICABLE", F.concat_ws(" ", F.lit("Not applicable:"), F.col("gate"))),
        (kind.isNull(), "PASS", "PRESENCE", F.lit("No validation configured")),
        ((both | only) & missing, "FAIL", "MISSING", F.concat(F.lit("Declaration '"), field, F.lit("' not found"))),
        (form & missing, "NOT_APPLICABLE", "NOT_APPLICABLE", F.concat(F.lit("Declaration '"), field, F.lit("' not found, format check skipped"))),
        ((both | form) & unmatched, "FAIL", "FORMAT", F.concat(F.lit("Value '"), text, F.lit("' does not match '"), F.col("pattern"), F.lit("'"))),
        (both & lacking.isNotNull(), "FAIL", "FORMAT", F.concat(F.lit("Value '"), text, F.lit("' must contain '"), lacking, F.lit("'"))),
        (both | form, "PASS", "FORMAT", F.concat(F.lit("Declaration '"), field, F.lit("' matches"))),
        (only, "PASS", "PRESENCE", F.concat(F.lit("Declaration '"), field, F.lit("' is present"))),
    ]
    verdict = F.lit(None)
    for test, name, type_, detail in reversed(cases):
        value = F.struct(F.lit(name).alias("verdict"), F.lit(type_).alias("verdict_type"), detail.alias("detail"))
        verdict = F.when(test, value).otherwise(verdict if verdict is not None and test is not cases[-1][0] else F.struct(F.lit("PASS").alias("verdict"), F.lit("PRESENCE").alias("verdict_type"), F.concat(F.lit("Unknown validation type '"), kind, F.lit("'")).alias("detail")))
    # the target is not named where the rule doesn't get as far as its validation
    target = F.when(F.col("gate").isNull() & kind.isin("regex_and_presence", "presence_only", "format_check"), field)
    rows = rows.withColumn("v", F.when(F.col("rule_version_id").isNotNull(), verdict))
    return rows.select(F.col("id").alias("inspection_id"), *also, "rule_version_id", "rule_key", "rule_order", target.alias("field_type"), "v.verdict", "v.verdict_type", "v.detail", "text", F.lit(None).cast("double").alias("confidence"))


def missing_declarations(inspections: DataFrame, rules: DataFrame, declarations: DataFrame) -> DataFrame:
    """Fields that a rule in force requires and no declaration gives: a set difference."""
    need = applicable_rules(inspections, rules).filter(F.col("validation_type").isin("regex_and_presence", "presence_only")).select(F.col("id").alias("inspection_id"), F.col("field").alias("field_type")).distinct()
    return need.join(declarations.filter("text is not null").select("inspection_id", "field_type"), ["inspection_id", "field_type"], "left_anti")


def current_version(rules: DataFrame, today: str) -> DataFrame:
    """Of each rule the latest version by effective_date that is published and not ended."""
    open_ = rules.filter("is_published").filter(F.col("end_date").isNull() | (F.col("end_date") >= F.lit(today).cast("date")))
    rank = F.row_number().over(W.partitionBy("rule_key").orderBy(F.desc("effective_date"), F.desc("version"), "rule_version_id"))
    return open_.withColumn("rn", rank).filter("rn = 1").drop("rn")


def list_rules(rules: DataFrame, today: str, like: str | None = None, after: str | None = None, before: str | None = None, page: int = 1, page_size: int = 20) -> DataFrame:
    """A page of the rules that have a current version, by key."""
    rows = current_version(rules, today)
    if like:
        rows = rows.filter(F.col("rule_key").ilike(f"%{like}%"))
    if after:
        rows = rows.filter(F.col("effective_date") >= F.lit(after).cast("date"))
    if before:
        rows = rows.filter(F.col("effective_date") <= F.lit(before).cast("date"))
    return rows.orderBy("rule_key").offset((page - 1) * page_size).limit(page_size)


def rule_detail(rules: DataFrame) -> DataFrame:
    """Per rule: its versions in order, how many are published, and the first published one."""
    versions = F.array_join(F.array_sort(F.collect_list("version")).cast("array<string>"), ",")
    current = F.min(F.when(F.col("is_published"), F.col("version")))
    return rules.groupBy("rule_key").agg(versions.alias("versions"), F.count_if("is_published").alias("n_published"), current.alias("current_version"))


def overlapping_versions(rules: DataFrame) -> DataFrame:
    """Pairs of published versions of one rule whose inclusive intervals overlap; an open end is 9999-12-31.

    A sweep: a rule's versions are numbered by their start, and one that ends on some day overlaps exactly those that
    start after it and not after that day, which are consecutive numbers. So the work is to number starts and ends, and
    then in proportion to the pairs. Versions meet by blocks of NUMBERS consecutive numbers, so that what is shuffled is
    in proportion to the versions, a row for each block that one spans, and pairs arise where they meet. Numbers are counted within a year of a rule and shifted by the years before, so a
    rule with very many versions is no task's work.
    """
    open_end = F.lit("9999-12-31").cast("date")
    rows = rules.filter("is_published").filter("effective_date is not null").select("rule_key", "rule_version_id", F.col("effective_date").alias("start"), F.coalesce("end_date", open_end).alias("last"))
    starts = rows.select("*", F.lit(1).alias("starts"), F.col("start").alias("on"))
    # an open end needs no counting: all that start later
    ends = rows.filter(F.col("last") < open_end).select("*", F.lit(0).alias("starts"), F.col("last").alias("on"))
    events = starts.unionByName(ends).withColumn("year", F.year("on"))
    counts = events.groupBy("rule_key", "year").agg(F.sum("starts").alias("k"))
    rule = W.partitionBy("rule_key")
    before = counts.select("rule_key", "year", F.coalesce(F.sum("k").over(rule.orderBy("year").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("k").over(rule).alias("total"))
    # of one day the starts come first: an end is inclusive
    so_far = W.partitionBy("rule_key", "year").orderBy("on", F.desc("starts"), "rule_version_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = events.withColumn("n", F.sum("starts").over(so_far)).join(before, ["rule_key", "year"]).withColumn("n", F.col("before") + F.col("n"))
    at = numbered.groupBy("rule_key", "rule_version_id", "start", "last").agg(F.max(F.when(F.col("starts") == 1, F.col("n"))).alias("n"), F.max(F.when(F.col("starts") == 0, F.col("n"))).alias("to"), F.max("total").alias("total"))
    block = lambda n: F.floor(n / NUMBERS)
    own, place = F.array(F.struct(block(F.col("n")).alias("block"), F.lit(True).alias("own"))), lambda x: F.struct(x.alias("block"), F.lit(False).alias("own"))
    spans = F.when(F.col("to") > F.col("n"), F.transform(F.sequence(block(F.col("n") + 1), block(F.col("to"))), place)).otherwise(F.array().cast("array<struct<block:bigint,own:boolean>>"))
    rows = at.withColumn("to", F.coalesce("to", "total")).select("rule_key", F.col("rule_version_id").alias("one"), F.col("n").alias("after"), F.col("to").alias("until"), F.explode(F.concat(own, spans)).alias("b"))
    # the versions of a block, NUMBERS at most, beside each that spans it: a self-join would number all versions twice
    here = F.collect_list(F.when(F.col("b.own"), F.struct(F.col("one").alias("other"), F.col("after").alias("n"), F.col("until").alias("to")))).over(W.partitionBy("rule_key", "b.block"))
    met = rows.withColumn("here", here).filter("not b.own").select("rule_key", "one", "after", "until", F.inline("here"))
    # an interval that ends before it starts overlaps less than its start says: it ends with a number below its own
    met = met.filter((F.col("n") > F.col("after")) & (F.col("n") <= F.col("until")) & (F.col("to") >= F.col("after")) & (F.col("one") != F.col("other")))
    return met.select("rule_key", F.least("one", "other").alias("first"), F.greatest("one", "other").alias("second"))


def next_version(rules: DataFrame) -> DataFrame:
    return rules.groupBy("rule_key").agg((F.max("version") + 1).alias("next_version"))


def publish_issues(versions: DataFrame) -> DataFrame:
    """Why a version can't be published, or null: already published, no legal reference, key taken by another rule."""
    taken = F.count("*").over(W.partitionBy("rule_key")) > 1
    blank = F.trim(F.coalesce("legal_reference", F.lit(""))) == ""
    return versions.withColumn("issue", F.when(F.col("is_published"), "already_published").when(blank, "no_legal_reference").when(taken, "duplicate_key"))
