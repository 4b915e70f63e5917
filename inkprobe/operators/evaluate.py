"""Classifiers, predictions and their evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.wrapper import JavaModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprobe import params
from inkprobe.functions.ordering import running_totals
from inkprobe.operators import grouped_fits as gf
from inkprobe.session import run_folder

# Settings of the classifiers.
LR_STRENGTH = 1.0
FOREST_TREES, FOREST_DEPTH, FOREST_LEAF = 500, 5, 3

FOREST_MEMORY_MB = 1_024  # of histograms at a time, so that all trees grow in few passes

DEFAULT_MODELS = "logistic_regression,random_forest"


def _tally(df: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score."""
    return df.groupBy(*by, score).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"),
        F.sum(1 - F.col(label).cast("bigint")).alias("neg"))


def accuracy(df: DataFrame, by: Sequence[str] = (), prediction: str = "prediction",
             label: str = "label") -> DataFrame:
    hit = F.when(F.col(prediction) == F.col(label), 1.0).otherwise(0.0)
    return df.groupBy(*by).agg(F.avg(hit).alias("accuracy"))


def auc(df: DataFrame, score: str, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve; ties count half, NULL when a class is absent.

    Ties are aggregated first and the order is taken in buckets, so no task
    sees more than a slice of the scores.
    """
    ranked = running_totals(_tally(df, score, label, by), score, ["pos", "neg"], by)
    below = F.col("cum_neg") - F.col("neg") + F.col("neg") / 2
    area = F.sum(F.col("pos") * below)
    pairs = F.max("total_pos").cast("double") * F.max("total_neg")
    return ranked.groupBy(*by).agg(F.try_divide(area, pairs).alias("auc"))


def roc_curve(df: DataFrame, score: str, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """ROC points ``(*by, threshold, fpr, tpr)`` without collinear inner ones.

    Starts with (0, 0) at an infinite threshold. An inner point is collinear
    when the next score adds the same counts as its own.
    """
    by = list(by)
    ranked = running_totals(_tally(df, score, label, by), score, ["pos", "neg"], by, descending=True)
    first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
    last = F.col("next_pos").isNull()
    turn = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    points = ranked.filter(first | last | turn).select(
        *by, F.col(score).alias("threshold"),
        F.try_divide(F.col("cum_neg"), F.col("total_neg")).alias("fpr"),
        F.try_divide(F.col("cum_pos"), F.col("total_pos")).alias("tpr"))
    start = df.groupBy(*by).agg(F.count("*").alias("_n")).select(
        *by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


class _ForestModel(JavaModel):
    """A fitted forest that only predicts."""


class _Forest(RandomForestClassifier):
    """Spark's forest without a Python object for each tree, whose making takes longer than the fit."""

    def _create_model(self, java_model):
        return _ForestModel(java_model)


def _forest(seed: int, trees: int) -> _Forest:
    return _Forest(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=FOREST_DEPTH,
                   minInstancesPerNode=FOREST_LEAF, featureSubsetStrategy="sqrt", seed=seed,
                   maxMemoryInMB=FOREST_MEMORY_MB)


MODEL_NAMES = ("logistic_regression", "random_forest", "mlp")


def model_list(models: str) -> list[str]:
    names = [m.strip() for m in models.split(",")]
    for name in names:
        if name not in MODEL_NAMES:
            raise ValueError(f"no such model: {name!r}; known are {', '.join(MODEL_NAMES)}")
    return names


def as_vectors(features: DataFrame) -> DataFrame:
    """Feature arrays as ML vectors; undefined entries become 0."""
    clean = F.transform("x", lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))
    return features.withColumn("features", array_to_vector(clean)).withColumn(
        "label", F.col("label").cast("double")).drop("x")


def fit_validate(features: DataFrame, models: str = DEFAULT_MODELS, by: Sequence[str] = ("fold",),
                 seed: int = params.SEED, trees: int = FOREST_TREES, parallelism: int = 8) -> DataFrame:
    """Fit every model in every group, a fold for instance; returns the predictions of all rows.

    ``features``: (*by, doc_id, label, role, x), read once a step, so pass a
    stored table, best partitioned by ``by``. Logistic regression and the network fit all
    groups at once (:mod:`~inkprobe.operators.grouped_fits`), forests one after the other, some side
    by side. Only models and gradients reach the driver. Output:
    (model, *by, doc_id, label, role, proba, prediction).
    """
    names = model_list(models)
    groups = gf.groups_of(features, by)
    keep = ["doc_id", "label", "role"]
    parts = []
    if "logistic_regression" in names:
        parts.append(gf.predict(groups, gf.fit_logistic(groups, LR_STRENGTH), "logistic_regression", keep))
    if "mlp" in names:
        parts.append(gf.predict(groups, gf.fit_network(groups, seed=seed), "mlp", keep))
    if "random_forest" in names:
        path = run_folder(features.sparkSession, "forests")

        def run(g: int) -> None:
            # Written by itself, so that no task has to load the forests of other groups.
            rows = as_vectors(groups.numbered([g], training=False))
            fitted = _forest(seed, trees).fit(rows.filter("role = 'train'"))
            fitted.transform(rows).select(
                F.lit("random_forest").alias("model"), *by, "doc_id", F.col("label").cast("int").alias("label"),
                "role", vector_to_array("probability")[1].alias("proba"),
                F.col("prediction").cast("int").alias("prediction")).write.parquet(f"{path}/forest={g}")

        pool = ThreadPool(max(1, min(parallelism, len(groups.keys))))
        try:
            pool.map(run, range(len(groups.keys)))
        finally:
            pool.close()
        parts.append(features.sparkSession.read.parquet(path).drop("forest"))
    return reduce(DataFrame.unionByName, parts)


def fold_metrics(predictions: DataFrame, by: Sequence[str] = ("model", "fold")) -> DataFrame:
    """Accuracy and AUC of training and test rows per fold, one row per fold."""
    keys = [*by, "role"]
    both = accuracy(predictions, keys).join(auc(predictions, "proba", by=keys), keys)
    pick = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    return both.groupBy(*by).agg(
        pick("train", "accuracy").alias("train_acc"), pick("train", "auc").alias("train_auc"),
        pick("test", "accuracy").alias("test_acc"), pick("test", "auc").alias("test_auc"))
