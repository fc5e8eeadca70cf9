"""Product classification from names: character n-grams, TF-IDF and a multinomial logistic regression."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Category keys and the paths they stand for.
CATEGORIES = {
    "food_beverage_packaged_food": "Food & Beverage > Packaged Food",
    "food_beverage_beverages": "Food & Beverage > Beverages",
    "food_beverage_edible_oils": "Food & Beverage > Edible Oils & Fats",
    "personal_care_cosmetics": "Personal Care & Cosmetics > Cosmetics",
    "personal_care_toiletries": "Personal Care & Cosmetics > Toiletries",
    "household_cleaning": "Household > Cleaning Products",
    "household_home_care": "Household > Home Care",
    "health_pharma_otc": "Health & Pharma > OTC/Medical Device",
    "industrial_bulk": "Industrial/Bulk",
    "other_uncategorized": "Other/Uncategorized",
}
CONFIDENT = 0.6
#: Labelled rows that a model is fitted on at most, and partitions of them.
MOST_LABELLED, FIT_PARTITIONS = 50_000, 4
#: While texts are scored: counts held at once, words taken at once, and words remembered, with the letters of one at most.
COUNTS, WORDS, REMEMBERED, LETTERS = 1 << 20, 1 << 14, 1 << 14, 64


def category_paths(categories: DataFrame) -> DataFrame:
    """A two-level tree (id, name, parent_id) as paths."""
    parents = categories.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    return categories.join(parents, "parent_id", "left").select("id", F.concat_ws(" > ", "parent", "name").alias("path"))


def classifier_text(names: DataFrame, declarations: DataFrame) -> DataFrame:
    """Product name, then all declaration values that were found, in order."""
    values = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("value") != "NOT_FOUND", F.struct("ord", "value")))), lambda x: x["value"]), " ")
    said = declarations.groupBy("inspection_id").agg(values.alias("said"))
    return names.join(said, "inspection_id", "left").select("inspection_id", F.trim(F.concat_ws(" ", "product_name", F.nullif(F.col("said"), F.lit("")))).alias("text"))


def name_words(text: Column) -> Column:
    """The lower-cased words of a text."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


#: A word as name_words() has it: Java's white space is ASCII's.
_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


def char_ngrams(text: Column, low: int = 2, high: int = 4) -> Column:
    """Runs of ``low`` to ``high`` characters inside the lower-cased words, each with a space at both ends.

    A word shorter than a run counts once, however many sizes it is too short for.
    """
    padded = F.transform(name_words(text), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(w: Column, n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))
        return runs if n == low else F.when(F.length(w) >= n, runs).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(padded, lambda w: F.flatten(F.array(*[grams(w, n) for n in range(low, high + 1)]))))


def gram_counts(rows: DataFrame) -> DataFrame:
    """How often each gram stands in each text of rows (id, text): id, gram, n."""
    return rows.select("id", F.explode(char_ngrams(F.col("text"))).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("n"))


def known_grams(rows: DataFrame, counts: DataFrame, vocabulary: int) -> DataFrame:
    """The ``vocabulary`` grams that stand most often in all texts (of equally frequent ones the first in order), with
    idf: ln((1 + texts) / (1 + texts with it)) + 1."""
    known = counts.groupBy("gram").agg(F.sum("n").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "gram").limit(vocabulary)
    texts = rows.agg(F.count("*").alias("texts"))  # one row
    return known.crossJoin(F.broadcast(texts)).select("gram", (F.log((1 + F.col("texts")) / (1 + F.col("df"))) + 1).alias("idf"))


def gram_weights(counts: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (id, gram, weight): 1 + ln(n) times idf, of length 1 for each id. known is broadcast: a vocabulary at most."""
    raw = counts.join(F.broadcast(known), "gram").withColumn("w", (F.log("n") + 1) * F.col("idf"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "id").select("id", "gram", (F.col("w") / F.col("norm")).alias("weight"))


def char_ngram_tfidf(rows: DataFrame, vocabulary: int = 5000) -> DataFrame:
    """Rows (id, gram, weight): 1 + ln(tf) times ln((1 + n) / (1 + df)) + 1, of length 1 for each id.

    Only the ``vocabulary`` grams that stand most often in all texts count; of equally frequent ones the first in order.
    Texts are dealt by id before their grams are made, as these are some fifty times as many and a small file of texts
    would be one task's work; counts and norms need no shuffle then.
    """
    rows = rows.select("id", "text").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    counts = gram_counts(rows)
    return gram_weights(counts, known_grams(rows, counts, vocabulary))


@dataclass(frozen=True)
class NameModel:
    """A linear model over the weights of char_ngram_tfidf(): for each known gram its idf and a weight for each label,
    and an intercept for each label. A vocabulary of rows at most, so it is held by the driver and broadcast."""

    labels: list[str]
    intercepts: list[float]
    grams: list[tuple[str, float, list[float]]]

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.grams, _GRAMS).coalesce(1).write.mode("overwrite").parquet(f"{path}/grams")
        spark.createDataFrame(list(zip(range(len(self.labels)), self.labels, self.intercepts)), _LABELS).coalesce(1).write.mode("overwrite").parquet(f"{path}/labels")


_GRAMS, _LABELS = "gram string, idf double, weights array<double>", "n int, label string, intercept double"


def load_model(spark: SparkSession, path: str) -> NameModel:
    """A model that save() wrote."""
    labels = spark.read.parquet(f"{path}/labels").orderBy("n").collect()
    grams = spark.read.parquet(f"{path}/grams").orderBy("gram").collect()
    return NameModel([r["label"] for r in labels], [r["intercept"] for r in labels], [(r["gram"], r["idf"], list(r["weights"])) for r in grams])


def known_weights(words: Iterable[str], place: dict[str, int], idf: list[float], low: int = 2, high: int = 4) -> tuple[list[int], list[float]]:
    """Of one text's words the places of its known grams, ascending, and their weights as gram_weights() gives them.

    Only known grams are held, so that a very long text takes no more room than the vocabulary.
    """
    found = Counter(place.get(w[i : i + n]) for w in map(" {} ".format, words) for n in range(low, high + 1) for i in range(len(w) - n + 1))
    found.pop(None, None)
    at = sorted(found)
    raw = [(math.log(found[k]) + 1) * idf[k] for k in at]
    norm = math.sqrt(sum(x * x for x in raw))
    return at, [x / norm for x in raw]


def word_grams(place: dict[str, int], low: int = 2, high: int = 4) -> Callable[[str], tuple[np.ndarray, np.ndarray]]:
    """A function from a word to the places of its known grams and how often each stands in it. Words come again and
    again, so short ones are remembered; of a long one no more is held than the vocabulary."""

    def look(word: str) -> tuple[np.ndarray, np.ndarray]:
        w = f" {word} "
        found = Counter(place.get(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1))
        found.pop(None, None)
        return np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.float64, len(found))

    remembered = lru_cache(REMEMBERED)(look)
    return lambda word: remembered(word) if len(word) <= LETTERS else look(word)


def scores(texts: list[str], grams: Callable[[str], tuple[np.ndarray, np.ndarray]], idf: np.ndarray, weights: np.ndarray, intercepts: np.ndarray) -> np.ndarray:
    """Of each lower-cased text its sum for each label: the weights of known_weights() times those of the model.

    Texts are counted together, as many at once as COUNTS allows; each row's sums are taken in the order of the places,
    so that they don't depend on the rows beside it.
    """
    size, at_once, found = len(idf), max(1, COUNTS // max(1, len(idf))), []
    for begin in range(0, len(texts), at_once):
        some = texts[begin : begin + at_once]
        counts = np.zeros(len(some) * size)
        words = ((k, word) for k, text in enumerate(some) for word in _WORD.findall(text))
        while part := list(islice(words, WORDS)):
            at, n = zip(*(grams(word) for _, word in part))
            row = np.repeat([k * size for k, _ in part], [len(a) for a in at])
            # counts of the rows that this part is of
            first, last = part[0][0] * size, (part[-1][0] + 1) * size
            counts[first:last] += np.bincount(row + np.concatenate(at) - first, np.concatenate(n), last - first)
        held = np.flatnonzero(counts)
        row, at = np.divmod(held, max(1, size))
        raw = (np.log(counts[held]) + 1) * idf[at]
        weight = raw / np.sqrt(np.bincount(row, raw * raw, len(some)))[row]
        found.append(np.stack([np.bincount(row, weight * weights[at, k], len(some)) for k in range(len(intercepts))], axis=1))
    return np.concatenate([np.zeros((0, len(intercepts))), *found]) + intercepts


def train_classifier(labelled: DataFrame, vocabulary: int = 5000, most: int = MOST_LABELLED) -> NameModel:
    """A multinomial logistic regression on the weights of char_ngram_tfidf(), from rows (text, label).

    It is fitted on at most ``most`` rows, those first by a hash of the text, and the vocabulary and idf are those of
    the same rows. Rows without a label are left out; a null text has no grams.
    """
    order = [F.xxhash64("text"), F.col("text"), F.col("label")]
    rows = labelled.filter("label is not null").select(F.coalesce("text", F.lit("")).alias("text"), "label").orderBy(*order).limit(most)
    rows = rows.withColumn("id", F.row_number().over(W.orderBy(*order))).repartition(FIT_PARTITIONS, "id").persist()  # most rows, by one task
    try:
        labels = sorted(r["label"] for r in rows.select("label").distinct().collect())
        known = sorted(map(tuple, known_grams(rows, gram_counts(rows), vocabulary).collect()))
        if not known or len(labels) < 2:
            return NameModel(labels, [0.0] * len(labels), [(gram, idf, [0.0] * len(labels)) for gram, idf in known])
        place, idf, size = {gram: k for k, (gram, _) in enumerate(known)}, [idf for _, idf in known], len(known)
        vector = F.udf(lambda words: Vectors.sparse(size, *known_weights(words, place, idf)), VectorUDT())  # at most ``most`` rows
        number = (F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1).cast("double")
        # each step of the fit is a job with a task for each partition: few for so few rows
        ready = rows.select(number.alias("label"), vector(name_words(F.col("text"))).alias("features"))
        fitted = LogisticRegression(family="multinomial", maxIter=50, regParam=0.001).fit(ready)
        weights = fitted.coefficientMatrix.toArray()
        return NameModel(labels, [float(x) for x in fitted.interceptVector.toArray()], [(gram, idf, [float(x) for x in weights[:, k]]) for k, (gram, idf) in enumerate(known)])
    finally:
        rows.unpersist()


def classify(rows: DataFrame, model: NameModel) -> DataFrame:
    """Rows with label and confidence, the greatest probability; an empty text is other_uncategorized at 0.

    Of equal probabilities the first label counts. Each row is scored by itself, in Arrow batches of texts: nothing is
    shuffled and no grams are made rows (in rows, they took nine times as long).
    """
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    if not model.labels:
        return rows.withColumn("label", F.lit("other_uncategorized")).withColumn("confidence", F.lit(0.0))
    place, idf = {gram: k for k, (gram, _, _) in enumerate(model.grams)}, np.array([idf for _, idf, _ in model.grams])
    weights = np.array([w for _, _, w in model.grams]).reshape(len(idf), len(model.labels))
    intercepts = np.array(model.intercepts)

    @F.pandas_udf("best int, sure double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grams = word_grams(place)
        for texts in batches:
            z = scores(texts.tolist(), grams, idf, weights, intercepts)
            yield pd.DataFrame({"best": z.argmax(axis=1), "sure": 1 / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)})

    scored = rows.withColumn("__s", score(F.lower(F.coalesce("text", F.lit("")))))
    label = F.get(F.array(*map(F.lit, model.labels)), F.col("__s.best"))
    return scored.select(*rows.columns, F.when(blank, "other_uncategorized").otherwise(label).alias("label"), F.when(blank, 0.0).otherwise(F.col("__s.sure")).alias("confidence"))


def route_category(rows: DataFrame) -> DataFrame:
    """Whether a label is sure enough, and its path."""
    path = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])[F.col("label")]
    return rows.withColumn("is_confident", F.col("confidence") >= CONFIDENT).withColumn("needs_manual_selection", F.col("confidence") < CONFIDENT).withColumn("path", F.coalesce(path, F.lit(CATEGORIES["other_uncategorized"])))
