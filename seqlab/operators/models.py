"""Classifier training, hold-out error, metrics rows and model storage."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.classification import (DecisionTreeClassificationModel, DecisionTreeClassifier, GBTClassifier,
                                       LogisticRegression, LogisticRegressionModel, OneVsRest, OneVsRestModel,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALGORITHMS = ("tree", "forest", "logistic", "gbt")


def make_estimator(algorithm: str, *, features_col: str = "features", label_col: str = "label",
                   impurity: str = "gini", max_depth: int = 10, max_bins: int = 32, num_trees: int = 20,
                   feature_subset: str = "auto", min_instances_per_node: int = 1, min_info_gain: float = 0.0,
                   max_iter: int = 20, seed: int = 42, parallelism: int = 4):
    """Estimator by name (unknown names are an error, not a silent default)."""
    common = dict(featuresCol=features_col, labelCol=label_col)
    tree = dict(impurity=impurity, maxDepth=max_depth, maxBins=max_bins, seed=seed,
                minInstancesPerNode=min_instances_per_node, minInfoGain=min_info_gain)
    if algorithm == "tree":
        return DecisionTreeClassifier(**common, **tree)
    if algorithm == "forest":
        return RandomForestClassifier(**common, **tree, numTrees=num_trees, featureSubsetStrategy=feature_subset)
    if algorithm == "logistic":
        return LogisticRegression(**common, family="multinomial", fitIntercept=False, maxIter=max(max_iter, 100))
    if algorithm == "gbt":
        # Boosted trees are binary in Spark ML: one model per class.
        base = GBTClassifier(maxIter=max_iter, maxDepth=3, maxBins=max_bins, seed=seed)
        return OneVsRest(classifier=base, parallelism=parallelism, **common)
    raise ValueError(f"unknown algorithm {algorithm!r}; expected one of {ALGORITHMS}")


def train(algorithm: str, data: DataFrame, **params):
    """Fit on ``data`` (persisted for the iterative passes of the learner)."""
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return make_estimator(algorithm, **params).fit(data)
    finally:
        data.unpersist()


def error_rate(label_col: str = "label", prediction_col: str = "prediction") -> Column:
    """Fraction of rows whose prediction differs from the label."""
    return F.avg((F.col(label_col) != F.col(prediction_col)).cast("double"))


def majority_vote(preds: list[Column]) -> Column:
    """Most frequent value of ``preds``; ties go to the smaller value."""
    arr = F.array(*preds)
    best = F.array_max(F.transform(arr, lambda v: F.struct(
        F.size(F.filter(arr, lambda u: u == v)).alias("n"), (-v).alias("neg"))))
    return -best["neg"]


def forest_tree_predictions(model: RandomForestClassificationModel, df: DataFrame,
                            features_col: str = "features") -> tuple[DataFrame, list[str]]:
    """Add one prediction column per tree (each tree's own JVM transform)."""
    cols = []
    out = df
    for i, t in enumerate(model.trees):
        name = f"__tree{i}"
        t = t.copy().setFeaturesCol(features_col).setPredictionCol(name) \
            .setRawPredictionCol(f"__raw{i}").setProbabilityCol(f"__prob{i}")
        out = t.transform(out).drop(f"__raw{i}", f"__prob{i}")
        cols.append(name)
    return out, cols


def predict(model, df: DataFrame, forest_vote: str = "majority", features_col: str = "features") -> DataFrame:
    """``model.transform`` with the reference's forest rule by default: each
    tree votes for one class and the most voted class wins (ties to the
    smaller class). ``forest_vote='probability'`` keeps Spark ML's averaged
    class probabilities."""
    if isinstance(model, RandomForestClassificationModel) and forest_vote == "majority":
        out, cols = forest_tree_predictions(model, df, features_col)
        return out.withColumn("prediction", majority_vote([F.col(c) for c in cols])).drop(*cols)
    return model.transform(df)


def evaluate(model, test: DataFrame, label_col: str = "label", forest_vote: str = "majority") -> float:
    pred = predict(model, test, forest_vote)
    return pred.agg(error_rate(label_col).alias("e")).first()["e"]


def loss_gradient(scored: DataFrame) -> DataFrame:
    """``k, j, g, scale``: the gradient of the mean multinomial log-loss by class and feature,
    mean((p_k - [label = k]) * x_j), and the feature's mean size, at the weights that gave
    ``probability``. One aggregation over (row, class)."""
    rows = scored.select(F.col("label").cast("int").alias("y"), vector_to_array("features").alias("x"),
                         F.posexplode(vector_to_array("probability")).alias("k", "p"))
    off = F.col("p") - (F.col("y") == F.col("k")).cast("double")
    per = rows.select("k", F.posexplode(F.transform("x", lambda v: F.struct((off * v).alias("g"), F.abs(v).alias("s")))).alias("j", "e"))
    return per.groupBy("k", "j").agg(F.avg("e.g").alias("g"), F.greatest(F.avg("e.s"), F.lit(1e-12)).alias("scale"))


def metrics_row(spark: SparkSession, *, algorithm: str, dataset: str, n_classes: int, test_error: float | None,
                n_train: int, n_test: int, n_trees: int | None = None, model_summary: str = "") -> DataFrame:
    """One report row (dataset name, class count, tree count, error, model
    summary) for an append-only metrics table."""
    return spark.createDataFrame(
        [(algorithm, dataset, int(n_classes), None if n_trees is None else int(n_trees), test_error,
          int(n_train), int(n_test), model_summary)],
        "algorithm string, dataset string, n_classes int, n_trees int, test_error double, "
        "n_train long, n_test long, model_summary string")


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


_LOADERS = {
    "tree": DecisionTreeClassificationModel,
    "forest": RandomForestClassificationModel,
    "logistic": LogisticRegressionModel,
    "gbt": OneVsRestModel,
}


def load_model(algorithm: str, path: str):
    return _LOADERS[algorithm].load(path)
