"""How often operators go through their rows, and what they deal over tasks."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridecl.operators import classify, extract, rules


def plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_texts_are_dealt_before_their_grams_are_made(spark, tmp_path, capsys):
    # a file of few bytes is one task, whose grams would be counted in it
    spark.range(50).select("id", F.concat(F.lit("oil and tea "), "id").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    said = plan(classify.char_ngram_tfidf(rows), capsys)
    assert re.search(r"hashpartitioning\(id#\d+L?, \d+\)", said) and not re.search(r"hashpartitioning\(id#\d+L?, gram", said)


@pytest.mark.parametrize("find", [extract.extract_dates, lambda t: extract.complete_fields(extract.best_candidates(extract.declaration_candidates(t)))], ids=["dates", "fields"])
def test_tokens_are_read_once(spark, tmp_path, capsys, find):
    rows = [("a", 0, "MFG 08/2026 Rs. 5", 0.9), ("a", 1, "PKD 12-2025", 0.4), ("b", 0, "500gm", 0.5), ("c", 0, "import mfd", 0.5)]
    spark.createDataFrame(rows, "inspection_id string, seq int, text string, confidence double").write.parquet(f"{tmp_path}/t")
    found = find(extract.normalize_tokens(spark.read.parquet(f"{tmp_path}/t")))
    assert len(re.findall(r"FileScan parquet", plan(found, capsys))) == 1
    assert found.count() > 0


def test_rows_with_rules_are_not_shuffled(spark, tmp_path, capsys):
    inspections = spark.createDataFrame([("1", "Food", "retail", dt.date(2024, 1, 1)), ("2", None, None, dt.date(2024, 1, 1))], "id string, category string, package_type string, day date")
    said = [("1", "mrp", "Rs. 5", None, 1), ("1", "mrp", "Rs. 7", 0.5, 3), ("1", "mrp", "Rs. 6", 0.5, 2), ("1", "mfg_date", None, 0.9, 4)]
    declarations = spark.createDataFrame(said, "inspection_id string, field_type string, text string, confidence double, ord int")
    inspections.write.parquet(f"{tmp_path}/i")
    declarations.write.parquet(f"{tmp_path}/d")
    found = rules.evaluate_rules(spark.read.parquet(f"{tmp_path}/i"), rules.seed_rules(spark), spark.read.parquet(f"{tmp_path}/d")).filter("verdict_type <> 'NOT_APPLICABLE'")
    assert not re.search(r"hashpartitioning\((id#\d+, field#|inspection_id#\d+, field_type#)", plan(found, capsys))
    # the surest, of equals the first by ord; one without a text is missing
    got = {(r.inspection_id, r.field_type): r.text for r in found.collect()}
    assert got == {("1", f): "Rs. 6" if f == "mrp" else None for _, _, f, _, _ in rules.SEED_RULES}


def test_methods_for_tokens_are_small_enough_to_be_compiled(spark, tmp_path, capsys):
    # the JVM interprets methods of over 8,000 bytes for ever; a failing cast costs an exception for each token
    rows = [("a", 0, "MFG 08/2026 Rs. 5", 0.9)]
    spark.createDataFrame(rows, "inspection_id string, seq int, text string, confidence double").write.parquet(f"{tmp_path}/t")
    capsys.readouterr()
    extract.normalize_tokens(spark.read.parquet(f"{tmp_path}/t")).explain("codegen")
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)
    assert sizes and max(map(int, sizes)) < 8000


def test_texts_are_scored_together_as_alone():
    grams = sorted({w[i : i + n] for w in (" oil ", " tea ", " soap ", f" {'ab' * 50} ") for n in (2, 3, 4) for i in range(len(w) - n + 1)})
    place, idf = {g: k for k, g in enumerate(grams)}, np.arange(1.0, len(grams) + 1)
    weights, bias = np.sin(np.arange(3.0 * len(grams))).reshape(-1, 3), np.array([0.1, 0.2, 0.3])
    texts = ["oil tea", "", "  soap\toil oil", "ab" * 50, "xyz", "tea oil"] * 3 + ["oil " * 40_000]
    got = classify.scores(texts, classify.word_grams(place), idf, weights, bias)
    for text, z in zip(texts, got):
        at, w = classify.known_weights(re.split(r"[ \t\n\x0b\f\r]+", text), place, idf.tolist())
        assert np.allclose(z, np.array(w) @ weights[at] + bias if at else bias)
    assert classify.scores([], classify.word_grams(place), idf, weights, bias).shape == (0, 3)
    assert np.allclose(classify.scores(["oil"], classify.word_grams({}), np.zeros(0), np.zeros((0, 3)), bias), bias)
