"""The pipeline's one pass against its steps, each as an operator of its own."""

import datetime as dt

from pyspark.sql import functions as F

from veridecl.operators import classify, compliance, extract, pipeline, rules

RULE = "rule_version_id string, rule_key string, version int, effective_date date, end_date date, is_published boolean, product_categories array<string>, exclude_categories array<string>, package_type string, validation_type string, field string, pattern string, must_contain array<string>"


def test_run_pipeline_is_its_steps(spark):
    day = dt.date(2024, 5, 1)
    oils, soap = "food_beverage_edible_oils", "personal_care_toiletries"
    train = spark.createDataFrame([(f"{n} {i}", k) for i in range(6) for n, k in (("Mustard Oil", oils), ("Neem Soap", soap))], "text string, label string")
    model = classify.train_classifier(train, vocabulary=200)
    lines = ["Manufactured by ABC Industries, Pune", "MRP Rs. 120", "Net 500gm", "MFG 08/2026", "Rs. 90", "Made in India", " "]
    tokens = [(str(i), s, line, 0.3 + (i + 2 * s) % 7 / 10) for i in range(1, 7) for s, line in enumerate(lines) if i == 1 or (s + i) % 3]
    tokens = spark.createDataFrame(tokens, "inspection_id string, seq int, text string, confidence double")
    # 7 has no tokens, 8 neither tokens nor a name, 5 comes before all rules, 9 has no day
    inspections = [("1", "Mustard Oil", "retail", day), ("2", "Neem Soap", "retail", day), ("3", "Mustard Oil", "wholesale", day), ("4", "Neem Soap", None, day), ("5", "Mustard Oil", "retail", dt.date(2001, 1, 1)), ("6", None, "retail", day), ("7", "Neem Soap", "retail", day), ("8", None, "retail", day), ("9", "Mustard Oil", "retail", None)]
    inspections = spark.createDataFrame(inspections, "id string, product_name string, package_type string, day date")
    path = classify.CATEGORIES[oils]
    versions = [
        ("r1", "MRP", 1, dt.date(2020, 1, 1), None, True, [path, "Food & Beverage"], None, "retail", "regex_and_presence", "mrp", r"\d{3}", None), ("r2", "NET", 1, dt.date(2020, 1, 1), dt.date(2025, 1, 1), True, [path], None, None, "presence_only", "net_quantity", None, None),
        ("r3", "MAKER", 2, dt.date(2022, 1, 1), None, True, [path], ["Industrial/Bulk"], None, "presence_only", "manufacturer_name", None, None), ("r4", "DATE", 1, dt.date(2026, 1, 1), None, True, ["ALL"], None, None, "format_check", "mfg_date", "2026", None),
    ]
    images = spark.createDataFrame([(1, "1", dt.datetime(2024, 1, 1), 0.9), (2, "1", dt.datetime(2024, 1, 2), 0.4), (3, "2", None, None), (4, "7", dt.datetime(2024, 1, 1), 0.8)], "id long, inspection_id string, uploaded_at timestamp, quality_score double")

    for some in (versions, versions[3:], []):
        rule_versions = spark.createDataFrame(some, RULE)
        got = pipeline.run_pipeline(tokens, inspections, rule_versions, images, model)
        extracted = extract.extract_declarations(extract.normalize_tokens(tokens))
        named = inspections.select(F.col("id").alias("inspection_id"), "product_name")
        found = classify.route_category(classify.classify(classify.classifier_text(named, extracted), model)).select("inspection_id", F.col("path").alias("category"), F.col("confidence").alias("category_confidence"))
        seen = inspections.join(found.withColumnRenamed("inspection_id", "id"), "id").select("id", "category", "package_type", "day")
        said = pipeline.as_declarations(extracted)
        want = compliance.outcomes(inspections, rules.evaluate_rules(seen, rule_versions, said), said, images).join(found, "inspection_id")
        columns = ["inspection_id", "category", "category_confidence", "overall_status", "status_reason", "n_extracted", "n_pass", "n_fail", "n_na", "violations", "evidence"]
        rows = lambda df: sorted(map(str, df.select(columns).collect()))
        assert rows(got) == rows(want) and got.count() == 9
        assert {r.inspection_id: r.warnings for r in got.collect() if r.warnings} == {"1": ["Low image quality: 0.40"]}
    assert got.agg(F.sum("n_pass") + F.sum("n_fail") + F.sum("n_na")).first()[0] == 0
