"""Toxicity by a chain of linear classifiers, with out-of-fold predictions between the links."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The chain: each category with the condition on ``labels`` that makes a document positive.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
#: Labelled documents that the chain is fitted on at most (the smallest hashes of doc_id), distinct words that it knows
#: at most, and folds of the out-of-fold predictions.
MOST_LABELLED, MOST_WORDS, FOLDS = 20_000, 1 << 16, 3
#: A word is known if it stands in so many of the labelled documents, and if the share of positive ones among these is
#: so many standard deviations from the share among all, squared, for any category. Else rare words, of which there is
#: no end, would be learnt by heart.
LEAST_DOCUMENTS, LEAST_SCORE = 3, 20.0
THRESHOLD = 0.3
#: Partitions of the labelled documents while models are fitted. Their number is bounded, and each step of a fit is a job
#: with a task for each partition: those of the scan would be far too many.
FIT_PARTITIONS = 12


def words(text: Column) -> Column:
    """The distinct lower-cased words of a text: runs of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


class _Link:
    """One category of the chain: a logistic regression, or a constant where the labels are all alike."""

    def __init__(self, train: DataFrame, label: str, inputs: Sequence[str]) -> None:
        self.inputs = list(inputs)
        row = train.agg(F.avg(label).alias("share"), F.count("*").alias("n")).first()
        self.constant, self.model = float(row["share"] or 0.0), None
        if 0 < self.constant < 1:
            self.model = LogisticRegression(featuresCol="__x", labelCol=label, maxIter=40, regParam=0.003, tol=1e-5, aggregationDepth=2).fit(self._with_inputs(train))

    def _with_inputs(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=["__words", *self.inputs], outputCol="__x").transform(df)

    def score(self, df: DataFrame, column: str) -> DataFrame:
        if self.model is None:
            return df.withColumn(column, F.lit(self.constant))
        model = self.model.copy({self.model.probabilityCol: "__p", self.model.rawPredictionCol: "__r", self.model.predictionCol: ""})
        return model.transform(self._with_inputs(df)).withColumn(column, vector_to_array("__p")[1]).drop("__p", "__r", "__x")


class Chain:
    """Fitted on documents with labels; scores any documents."""

    def __init__(self, documents: DataFrame, labels: DataFrame, categories=CATEGORIES, most_labelled: int = MOST_LABELLED) -> None:
        self.names = [name for name, _ in categories]
        cases = [F.coalesce(F.expr(condition), F.lit(False)).cast("double") for _, condition in categories]
        known = labels.filter("doc_id is not null").select("doc_id", *(c.alias(f"y_{n}") for c, n in zip(cases, self.names)))
        chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", *(f"y_{n}" for n in self.names)).limit(most_labelled)
        # at most most_labelled rows of a few numbers, so it may be broadcast
        train = documents.select("doc_id", words(F.col("text")).alias("__w")).join(F.broadcast(chosen), "doc_id")
        train = train.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS))).repartition(FIT_PARTITIONS).persist()
        self.vocabulary, self.links = None, []
        try:
            if train.isEmpty():
                self.links = [_Link(train, f"y_{n}", []) for n in self.names]
                return
            self.vocabulary = self._telling_words(train)
            ready, earlier = train, []
            for name in self.names:
                self.links.append(_Link(self.vocabulary.transform(ready), f"y_{name}", earlier))
                if name != self.names[-1]:
                    before, ready = ready, self.out_of_fold(ready, name, earlier).persist()
                    ready.count()
                    if before is not train:
                        before.unpersist()
                    earlier.append(f"p_{name}")
            ready.unpersist()
        finally:
            train.unpersist()

    def out_of_fold(self, rows: DataFrame, name: str, earlier: Sequence[str]) -> DataFrame:
        """Labelled rows with p_<name> from models that know nothing of them: for each fold the words are chosen and the
        model is fitted by the other folds only."""
        parts = []
        for k in range(FOLDS):
            others = rows.filter(F.col("fold") != k)
            known = self._telling_words(others)
            parts.append(_Link(known.transform(others), f"y_{name}", earlier).score(known.transform(rows.filter(F.col("fold") == k)), f"p_{name}").drop("__words"))
        return functools.reduce(DataFrame.unionByName, parts)

    def _telling_words(self, train: DataFrame) -> CountVectorizerModel:
        labels = [f"y_{n}" for n in self.names]
        total = train.agg(*(F.avg(y).alias(y) for y in labels)).first()
        counts = train.select(F.explode("__w").alias("word"), *labels).groupBy("word").agg(F.count("*").alias("n"), *(F.sum(y).alias(y) for y in labels))
        deviation = [(F.col(y) - F.col("n") * total[y]) ** 2 / (F.col("n") * total[y] * (1 - total[y])) for y in labels if 0 < total[y] < 1]
        score = F.greatest(F.lit(0.0), *deviation, F.lit(0.0))
        best = counts.withColumn("score", score).filter((F.col("n") >= LEAST_DOCUMENTS) & (F.col("score") >= LEAST_SCORE)).orderBy(F.desc("score"), "word").limit(MOST_WORDS)
        found = [row["word"] for row in best.select("word").collect()]  # MOST_WORDS at most
        model = CountVectorizerModel.from_vocabulary(found or [""], inputCol="__w", outputCol="__words")
        return model.setBinary(True)

    def score(self, documents: DataFrame) -> DataFrame:
        """``documents`` with p_<category> for each category."""
        if self.vocabulary is None:
            scored = documents
            for name in self.names:
                scored = scored.withColumn(f"p_{name}", F.lit(0.0))
            return scored
        scored = self.vocabulary.transform(documents.withColumn("__w", words(F.col("text")))).drop("__w")
        for name, link in zip(self.names, self.links):
            scored = link.score(scored, f"p_{name}")
        return scored.drop("__words")


def toxicity(documents: DataFrame, labels: DataFrame, *, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """One row for each row of ``documents``: doc_id, p_low_quality, p_toxic, toxic (p_toxic > THRESHOLD).

    The chain is fitted on at most ``most_labelled`` documents that ``labels`` (doc_id, quality, toxic) covers: bags of
    words, the first category from the words, each later one from the words and the probabilities of all earlier ones.
    For fitting, those come from models that have not seen the document (FOLDS folds); for scoring, from the final ones.

    Null or empty texts have no words and get the probability of that; with no labels all probabilities are 0, and with
    labels all alike that share. Null labels are negative. Repeated rows get equal results; further columns are ignored.
    """
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = Chain(docs, labels.select("doc_id", "quality", "toxic"), most_labelled=most_labelled).score(docs)
    return scored.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") > THRESHOLD).alias("toxic"))


def drop_toxic(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` that the chain doesn't reject, in one pass.

    All columns come back as they are, whatever their names; null and empty texts are judged as in toxicity(), repeated
    rows alike, and an empty table gives no rows.
    """
    chain = Chain(documents.select("doc_id", F.col("text").cast("string").alias("text")), labels.select("doc_id", "quality", "toxic"), **options)
    # the row is one column beside its text, so that no column of its own meets those of the models
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    return chain.score(rows).filter(F.col("p_toxic") <= THRESHOLD).select("row.*")
