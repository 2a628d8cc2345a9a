"""The file study from texts to explained lines: sparse features, classifiers, forest weights of true positives.

Every step hands a stored table to the next one. The vocabulary is a table of the training part, rows stay
sparse from the counts to the neighbours and the forest.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from diffgauge.operators import models as L
from diffgauge.operators.features import terms_long
from diffgauge.operators.forest import explain_by_forest, explain_words_by_forest, predict_by_forest
from diffgauge.operators.joins import measured_lookup
from diffgauge.operators.neighbours import knn_vote
from diffgauge.operators.sampling import class_counts, smote_sparse
from diffgauge.operators.sparse_neighbours import nearest_sparse
from diffgauge.operators.sparse_trees import grow
from diffgauge.operators.vocabulary import column_moments, sparse_rows, term_index, with_vectors
from diffgauge.session import materialize


@dataclass
class Study:
    """Sparse training and test rows (label, key, indices, values) and what their columns mean."""

    key: str
    index: DataFrame            # term, df, index; the numeric columns follow behind
    width: int                  # columns
    train: DataFrame
    test: DataFrame

    def vectors(self, rows: DataFrame) -> DataFrame:
        return with_vectors(rows, self.width)


def study(files: DataFrame, key: str, text: str, numeric: Sequence[str] = (), min_df: int = 2, max_df: float = 0.5,
          by_row: bool = False) -> Study:
    """Features of ``files`` (label, key, text, numeric columns, split): the vocabulary is the training part's.

    Rows of one key are one bag of words; ``by_row`` gives each of them its own.
    """
    bag = key
    if by_row:
        bag = "_row"
        files = materialize(files.withColumn(bag, F.monotonically_increasing_id()))
    terms = materialize(terms_long(files, bag, text))
    train_keys = files.where("split = 'train'").select(bag)
    n_train = train_keys.count()
    index = term_index(terms.join(train_keys, bag, "left_semi"), n_train, min_df, max_df)
    rows = materialize(sparse_rows(files.select("label", *dict.fromkeys([key, bag]), "split", *numeric), terms, index, bag, numeric).select(
        "label", key, "split", "indices", "values"))
    return Study(key, index, index.count() + len(numeric), rows.where("split = 'train'").drop("split"),
                 rows.where("split = 'test'").drop("split"))


@dataclass
class TextModel:
    """A fitted model (its one stage) and the stored table of the terms its columns stand for."""

    model: PipelineModel
    index: DataFrame

    def transform(self, bags: Bags) -> DataFrame:
        return self.model.transform(bags.vectors(self.index))


@dataclass
class Bags:
    """Rows, a bag of words each, before they have columns: any vocabulary can be laid over them."""

    files: DataFrame
    terms: DataFrame            # _row, term, n
    numeric: Sequence[str] = ()

    @classmethod
    def of(cls, files: DataFrame, text: str, numeric: Sequence[str] = ()) -> Bags:
        files = materialize(files.withColumn("_row", F.monotonically_increasing_id()))
        return cls(files.drop(text), materialize(terms_long(files, "_row", text)), numeric)

    def vectors(self, index: DataFrame) -> DataFrame:
        """The rows as sparse vectors ``features`` of the terms in ``index`` and the numeric columns. Stored."""
        known = [F.coalesce(F.col(c), F.raise_error(F.lit(f"{c} must not be null")).cast("int")).alias(c) for c in self.numeric]
        rows = self.files.select(*(c for c in self.files.columns if c not in self.numeric), *known)
        return with_vectors(sparse_rows(rows, self.terms, index, "_row", self.numeric).drop("_row"), index.count() + len(self.numeric))


def text_model(spark: SparkSession, path: str, bags: Bags, weight: str | None = None) -> TextModel:
    """The logistic regression saved under ``path`` with the table of its terms beside it, fitted where none lies there.

    The vocabulary stays a table; the driver holds the model's numbers, one per column, and no term.
    """
    def fit() -> PipelineModel:
        index = term_index(bags.terms, bags.files.count())
        index.write.mode("overwrite").parquet(f"{path}-terms")
        rows = bags.vectors(index)
        return PipelineModel(stages=[L.logistic(rows.count(), weight=weight).fit(rows)])
    model = L.fit_or_load(spark, path, fit)
    return TextModel(model, spark.read.parquet(f"{path}-terms"))


def oversampled_rows(train: DataFrame, key: str, k: int = 10, seed: int = 2) -> DataFrame:
    """(label, indices, values): the training rows and SMOTE rows of the smaller class, all sparse."""
    counts = class_counts(train, "label")
    rows = train.select("label", "indices", "values")
    if len(counts) < 2:
        return rows
    small = min(counts, key=counts.get)
    new = smote_sparse(train, "label", key, k, seed, small)
    return rows.unionByName(new.select(F.lit(small).cast(train.schema["label"].dataType).alias("label"), "indices", "values"))


def fingerprint(rows: DataFrame) -> str:
    """A name for the content of a table: its rows counted and their hashes summed, in any order."""
    h = F.xxhash64(*rows.columns)
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"),
                 F.bit_xor(F.xxhash64(F.lit(1), *rows.columns)).alias("x")).first()
    return f"{r['n']}-{int(r['s'] or 0):x}-{(r['x'] or 0) & (1 << 64) - 1:016x}"


def catalogued(train: DataFrame, folder: str, name: Sequence, fit: Callable[[], PipelineModel]) -> str:
    """The path of a saved model below ``folder``, fitted if no model of these rows lies there.

    The path holds the name (project, technique, seed, ...) and the fingerprint of the training rows, so other
    rows never meet an old model.
    """
    path = "/".join([folder.rstrip("/"), *(f"{part}" for part in name), fingerprint(train)])
    L.fit_or_load(train.sparkSession, path, fit)
    return path


def naive_bayes(s: Study, smoothing: float = 1.0) -> DataFrame:
    """(key, label, prob, prediction) of the test rows by multinomial naive Bayes, the rule of ``models.naive_bayes``.

    The sums of a class are a table, a row per column: no task and no driver holds a class's vector.
    """
    def cells(rows: DataFrame, *keep: str) -> DataFrame:
        return rows.select(*keep, F.explode(F.arrays_zip("indices", "values")).alias("c")).select(
            *keep, F.col("c.indices").alias("index"), F.col("c.values").alias("v"))
    counts = class_counts(s.train, "label")
    if None in counts:
        raise ValueError("labels must not be null")
    classes = sorted(counts)
    sums = materialize(cells(s.train, "label").groupBy("index").agg(
        *(F.sum(F.when(F.col("label") == y, F.col("v")).otherwise(0.0)).alias(f"s{y}") for y in classes)))
    mass = sums.agg(*(F.coalesce(F.sum(f"s{y}"), F.lit(0.0)).alias(f"s{y}") for y in classes)).first()
    test = materialize(s.test.withColumn("_row", F.monotonically_increasing_id()))      # keys may repeat
    own = measured_lookup(cells(test, "_row"), sums, ["index"], most_rows=1_000_000)
    votes = own.groupBy("_row").agg(*(F.sum(F.col("v") * (
        F.log(F.coalesce(f"s{y}", F.lit(0.0)) + smoothing) - math.log(mass[f"s{y}"] + smoothing * s.width))).alias(f"p{y}") for y in classes))
    total = math.log(sum(counts.values()) + smoothing * len(classes))
    prior = {y: F.coalesce(f"p{y}", F.lit(0.0)) + (math.log(counts[y] + smoothing) - total) for y in classes}
    zero, one = (prior.get(y, F.lit(float("-inf"))) for y in (0, 1))
    return test.join(votes, "_row", "left").select(
        s.key, "label", (1.0 / (1.0 + F.exp(zero - one))).alias("prob"), (one > zero).cast("int").alias("prediction"))


def fit_forest(s: Study, seed: int = 2, trees: int = 200, depth: int = 30, smote_k: int = 10) -> DataFrame:
    """The stored nodes of a forest on SMOTE rows, grown without a number per row and column."""
    return grow(oversampled_rows(s.train, s.key, smote_k, seed), s.width, trees, depth, seed)


def predict(technique: str, s: Study, seed: int = 2, smote_k: int = 10, trees: int = 200, depth: int = 30,
            neighbours: int = 3) -> DataFrame:
    """(key, label, prob, prediction) of the test rows for one technique."""
    if technique == "KNN":
        near = nearest_sparse(s.test, s.train, s.key, neighbours)
        vote = knn_vote(near, s.train, s.key, "label").withColumnRenamed("query", s.key)
        return s.test.select(s.key, "label").join(vote, s.key)
    if technique == "Random Guessing":
        return L.random_guess(s.test, s.train, s.key, seed)
    if technique == "RF":
        return predict_by_forest(s.test, fit_forest(s, seed, trees, depth, smote_k), s.key)
    if technique == "DT":
        return predict_by_forest(s.test, grow(s.train.select("label", "indices", "values"), s.width, depth=depth, forest=False), s.key)
    if technique == "NB":
        return naive_bayes(s)
    if technique != "LG":
        raise ValueError(technique)
    train = s.vectors(s.train)
    return L.scored(L.logistic(train.count()).fit(train).transform(s.vectors(s.test)), s.key)


def compare(s: Study, dataset: str, techniques: Sequence[str] = L.TECHNIQUES) -> DataFrame:
    """The metric table over several techniques."""
    parts = [predict(t, s).select(F.lit(t).alias("Technique"), F.lit(dataset).alias("Datasets"), "label", "prob", "prediction")
             for t in techniques]
    return L.evaluate(reduce(DataFrame.unionByName, parts))


@dataclass
class Explained:
    predictions: DataFrame      # key, label, prob, prediction
    nodes: DataFrame            # the forest
    weights: DataFrame          # key, token, weight: of the files that were rightly predicted positive


def explain_true_positives(s: Study, seed: int = 2, trees: int = 200, depth: int = 30, smote_k: int = 10,
                           samples: int = 5_000) -> Explained:
    """Forest, its predictions of the test files, and the weight of every term of each true positive.

    Numeric columns take part in the explanation and are left out of the weights, as they are no tokens.
    """
    nodes = fit_forest(s, seed, trees, depth, smote_k)
    predictions = predict_by_forest(s.test, nodes, s.key)
    hits = predictions.where("label = 1 and prediction = 1").select(s.key)
    moments = column_moments(s.train, s.train.count())
    scores = explain_by_forest(s.test.join(hits, s.key, "left_semi"), moments, nodes, s.key, samples, seed)
    weights = materialize(scores.join(s.index, "index").select(s.key, F.col("term").alias("token"), F.col("score").alias("weight")))
    return Explained(predictions, nodes, weights)


WORD = r"([\p{L}\p{N}_]{2,})"


def explain_texts(rows: DataFrame, s: Study, nodes: DataFrame, text: str, samples: int = 10_000, features: int = 20,
                  seed: int = 2) -> DataFrame:
    """(key, token, score) for whole texts by a fitted forest; words keep their case, columns are those of their lower form."""
    own = rows.select(s.key, F.explode(F.regexp_extract_all(F.col(text), F.lit(WORD), 1)).alias("token"))
    counted = own.groupBy(s.key, "token").agg(F.count(F.lit(1)).alias("n")).withColumn("term", F.lower("token"))
    return explain_words_by_forest(counted.join(s.index.select("term", "index"), "term", "left"), nodes, s.key, samples,
                                   features, seed)
