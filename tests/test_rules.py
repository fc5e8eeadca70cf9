"""Rules in force against every pair of inspection and rule, and n-grams against a plain loop."""

import datetime as dt
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veridecl.operators import classify, rules

CATEGORIES = [
    None, "", "Food", "Food > Snacks", "Food > Snacks > Sweet", "Snacks", "A >B", "Food > Food", "Sweet > Food", "Foods > Snack", "*", "ALL", "A > B > A > B",
]
REQUIRED = [None, [], ["ALL"], ["x", "ALL"], ["Food"], ["Snacks"], ["Food", "Food > Snacks"], ["A"], ["B", "B"], ["Snacks > Sweet"], ["Food > Food"], ["Food >"], ["*"], [None, "Sweet"]]
DAY = dt.date


def selected(category, required):
    if not required or "ALL" in required:
        return True
    if category is None:
        return False
    return any(
        c is not None and (category == c or category.startswith(c + " >") or f" > {c} > " in category or category.endswith(" > " + c)) for c in required
    )


@pytest.mark.parametrize("most_broadcast", [rules.MOST_BROADCAST, 0])
def test_applicable_rules_against_all_pairs(spark, most_broadcast, monkeypatch):
    monkeypatch.setattr(rules, "MOST_BROADCAST", most_broadcast)
    spans = [(DAY(2020, 1, 1), None), (DAY(2021, 5, 5), DAY(2022, 5, 5)), (DAY(2022, 5, 5), DAY(2022, 5, 5)), (DAY(2150, 1, 1), None), (DAY(2020, 1, 1), DAY(2101, 1, 1))]
    versions = [(f"r{i}-{k}", f"R{i}", k, *span, True, need, None, None, "presence_only", "mrp", None, None) for i, need in enumerate(REQUIRED) for k, span in enumerate(spans)]
    flat = "rule_version_id string, rule_key string, version int, effective_date date, end_date date, is_published boolean, product_categories array<string>, exclude_categories array<string>, package_type string, validation_type string, field string, pattern string, must_contain array<string>"
    days = [DAY(2019, 1, 1), DAY(2020, 1, 1), DAY(2022, 5, 4), DAY(2022, 5, 5), DAY(2101, 7, 1), DAY(2200, 1, 1)]
    seen = [(f"{i}-{j}", c, "retail", d) for i, c in enumerate(CATEGORIES) for j, d in enumerate(days)]
    rows = rules.applicable_rules(spark.createDataFrame(seen, "id string, category string, package_type string, day date"), spark.createDataFrame(versions, flat))
    got = sorted(tuple(r) for r in rows.select("id", "rule_version_id", "rule_order").collect())
    want = []
    for id_, category, _, day in seen:
        hits = sorted((v[3], v[2], v[0]) for v in versions if v[3] <= day and (v[4] is None or v[4] > day) and selected(category, v[6]))
        want += [(id_, v, n + 1) for n, (_, _, v) in enumerate(hits)]
    assert got == sorted(want)


def test_matching_rules_without_the_end_of_a_path(spark):
    versions = spark.createDataFrame([(f"r{i}", need) for i, need in enumerate(REQUIRED)], "rule_version_id string, product_categories array<string>")
    seen = spark.createDataFrame([(f"{i}", c) for i, c in enumerate(CATEGORIES)], "id string, category string")
    for match in (rules.category_selected, rules.category_applies):
        got = sorted(map(tuple, rules.matching_rules(seen, versions, match).select("id", "rule_version_id").collect()))
        every = seen.crossJoin(versions).filter(match(F.col("category"), F.col("product_categories"))).select("id", "rule_version_id")
        assert got == sorted(map(tuple, every.collect()))


def test_overlaps_by_sweep_against_all_pairs(spark):
    rng = random.Random(6)
    day = lambda: DAY(2020, 1, 1) + dt.timedelta(rng.randrange(1200))
    rows = []
    for key in range(12):
        for k in range(rng.randrange(1, 30)):
            start = None if rng.random() < 0.03 else rng.choice([day(), DAY(2020, 6, 1), DAY(2020, 12, 31)])
            end = rng.choice([None, day(), start, DAY(2021, 1, 1)])  # some end before they start
            rows.append((f"k{key}", f"v{rng.randrange(100):02d}-{key}-{k}", start, end, rng.random() < 0.9))
    got = sorted(map(tuple, rules.overlapping_versions(spark.createDataFrame(rows, "rule_key string, rule_version_id string, effective_date date, end_date date, is_published boolean")).collect()))
    far = DAY(9999, 12, 31)
    want = []
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and a[4] and b[4] and a[2] and b[2] and a[2] <= (b[3] or far) and (a[3] or far) >= b[2]:
                want.append((a[0], a[1], b[1]))
    assert got == sorted(want) and len(want) > 200


def test_rules_meet_only_inspections_of_their_time(spark):
    """Of two thousand rules that follow one another, an inspection meets those of its part of time before dates are tested."""
    versions = [(f"r{k}", "R", k, DAY(2000, 1, 1) + dt.timedelta(k), DAY(2000, 1, 1) + dt.timedelta(k + 1), True, None, None, None, None, None, None, None) for k in range(2000)]
    flat = "rule_version_id string, rule_key string, version int, effective_date date, end_date date, is_published boolean, product_categories array<string>, exclude_categories array<string>, package_type string, validation_type string, field string, pattern string, must_contain array<string>"
    r, part = rules.time_parts(spark.createDataFrame(versions, flat))
    assert r.groupBy("part").count().agg(F.max("count")).first()[0] <= 2000 // rules.DATE_PARTS + 2 and r.count() <= 2000 + rules.DATE_PARTS
    days = spark.createDataFrame([(DAY(1999, 12, 31),), (DAY(2000, 1, 1),), (DAY(2050, 1, 1),), (None,)], "day date")
    assert [x[0] for x in days.select(part(F.col("day"))).collect()] == [None, 0, r.agg(F.max("part")).first()[0], None]
    none, part = rules.time_parts(spark.createDataFrame([], flat))
    assert none.count() == 0 and rules.applicable_rules(spark.createDataFrame([("1", "Food", "retail", DAY(2020, 1, 1))], "id string, category string, package_type string, day date"), spark.createDataFrame([], flat)).count() == 0


def test_char_ngrams_against_a_loop(spark):
    texts = ["a bc", "Sun Flower Oil", "  ", "", "ab  abcd é", "x"]

    def grams(text):
        out = []
        for word in text.lower().split():
            word = f" {word} "
            for n in (2, 3, 4):
                out.append(word[:n])
                out += [word[i : i + n] for i in range(1, len(word) - n + 1)]
                if len(word) <= n:  # shorter than the run: counted once
                    break
        return sorted(out)

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: sorted(r.g) for r in rows.select("id", classify.char_ngrams(F.col("text")).alias("g")).collect()}
    assert got == {i: grams(t) for i, t in enumerate(texts)}
    for most in (5000, 7):
        counts = {i: Counter(grams(t)) for i, t in enumerate(texts)}
        total, df = Counter(), Counter()
        for c in counts.values():
            total.update(c)
            df.update(set(c))
        known = sorted(total, key=lambda g: (-total[g], g.encode()))[:most]
        want = {}
        for i, c in counts.items():
            raw = {g: (1 + math.log(c[g])) * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g in known if g in c}
            norm = math.sqrt(sum(w * w for w in raw.values()))
            want |= {(i, g): pytest.approx(w / norm) for g, w in raw.items()}
        assert {(r.id, r.gram): r.weight for r in classify.char_ngram_tfidf(rows, most).collect()} == want


def test_versions_that_overlap_meet_by_blocks(spark, capsys):
    rows = [("k", f"v{n}", dt.date(2020, 1, 1) + dt.timedelta(days=n % 9 * 40), None if n % 4 == 0 else dt.date(2020, 1, 1) + dt.timedelta(days=n % 9 * 40 + n * 13 % 300 - 20), True) for n in range(150)]
    found = rules.overlapping_versions(spark.createDataFrame(rows, "rule_key string, rule_version_id string, effective_date date, end_date date, is_published boolean"))
    got = sorted(map(tuple, found.collect()))
    last = lambda r: r[3] or dt.date.max
    assert got == sorted(("k", *sorted((a[1], b[1]))) for i, a in enumerate(rows) for b in rows[:i] if a[2] <= last(b) and b[2] <= last(a))
    # rows are shuffled by block, not one for each pair
    found.explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(rule_key" in plan and not re.search(r"hashpartitioning\(rule_key#\d+, n#", plan)
