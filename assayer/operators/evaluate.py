"""Metrics of a predictions table, and a reason for each that cannot be computed."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayer.errors import AssayError
from assayer.operators.targets import BINARY

METRICS = "metric string, value double, reason string"

NO_PROBABILITY = "The model gave no probabilities, or only one class occurs."
NOT_BINARY = "Not computed for more than two classes."
TOO_FEW_ROWS = "R2 needs at least two test rows."
BAD_PROBABILITY = "Some probabilities are missing or not a number."
# A matrix is a square of so many classes at most.
MOST_CLASSES = 1_000


def _class_texts(predictions: DataFrame, label: str, prediction: str) -> tuple[Column, Column]:
    """Label and prediction as text, equal where they are equal as values.

    Spark's models predict doubles, whatever the type of the label: numbers of two types
    are compared as doubles, and whole ones are shown without a fraction.
    """
    columns = F.col(label), F.col(prediction)
    kinds = [predictions.select(c).schema[0].dataType for c in columns]
    if kinds[0] == kinds[1] or not all(isinstance(k, T.NumericType) for k in kinds):
        return tuple(c.cast("string") for c in columns)
    numbers = [c.cast("double") for c in columns]
    return tuple(
        F.when((d == F.floor(d)) & (F.abs(d) < 2.0 ** 53), d.cast("bigint").cast("string"))
        .otherwise(d.cast("string")) for d in numbers)


def confusion_counts(
    predictions: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """(label, prediction, count) of the pairs that occur; one row per pair of classes."""
    truth, called = _class_texts(predictions, label, prediction)
    return predictions.groupBy(
        truth.alias("label"), called.alias("prediction"),
    ).agg(F.count(F.lit(1)).alias("count"))


def confusion_matrix(
    predictions: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """The full square over all true and predicted classes, zeros included.

    The classes are read off the counted pairs, not off the rows; more of them than
    ``MOST_CLASSES`` are an error, as no matrix of continuous values is meant.
    """
    pairs = confusion_counts(predictions, label, prediction)
    several = pairs.select(F.explode(F.array("label", "prediction")).alias("c")).distinct()
    if several.limit(MOST_CLASSES + 1).count() > MOST_CLASSES:
        raise AssayError("too_many_classes",
                         f"A confusion matrix holds at most {MOST_CLASSES} classes.")
    classes = pairs.agg(F.array_sort(F.array_union(
        F.collect_set("label"), F.collect_set("prediction"))).alias("classes"))
    square = classes.select("classes", F.explode("classes").alias("label")).select(
        "label", F.explode("classes").alias("prediction"))
    return square.join(pairs, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"))


def class_scores(
    predictions: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """(class, support, precision, recall, f1) per class; 0 where undefined."""
    pairs = confusion_counts(predictions, label, prediction)
    seen = pairs.select(
        F.explode(F.array(
            F.struct(F.col("label").alias("class"), F.col("count").alias("support"),
                     F.lit(0).cast("bigint").alias("called")),
            F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("support"),
                     F.col("count").alias("called")))).alias("s"),
        F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0).alias("hit"),
    )
    # Every pair gives two rows, so each hit is counted twice.
    totals = seen.groupBy("s.class").agg(
        F.sum("s.support").alias("support"), F.sum("s.called").alias("called"),
        (F.sum("hit") / 2).alias("hits"))
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("hits"), F.col("called")), zero)
    recall = F.coalesce(F.try_divide(F.col("hits"), F.col("support")), zero)
    return totals.withColumns({"precision": precision, "recall": recall}).select(
        "class", "support", "hits", "precision", "recall",
        F.coalesce(F.try_divide(
            2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
            zero).alias("f1"))


def classification_metrics(
    predictions: DataFrame,
    task: str = BINARY,
    label: str = "label",
    prediction: str = "prediction",
    probability: str | None = None,
    positive: str | None = None,
) -> DataFrame:
    """(metric, value, reason): accuracy, support-weighted scores and ROC-AUC."""
    scores = class_scores(predictions, label, prediction)
    weight = F.sum("support")

    def weighted(name):
        return F.try_divide(F.sum(F.col(name) * F.col("support")), weight)

    totals = scores.agg(
        F.try_divide(F.sum("hits"), weight).alias("accuracy"),
        weighted("precision").alias("precision"), weighted("recall").alias("recall"),
        weighted("f1").alias("f1"))
    none = F.lit(None).cast("string")
    rows = totals.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.round(m, 6).alias("value"), none.alias("reason"))
        for m in ("accuracy", "precision", "recall", "f1")
    ])))
    return rows.unionAll(roc_auc(predictions, task, label, probability, positive))


def roc_auc(
    predictions: DataFrame,
    task: str = BINARY,
    label: str = "label",
    probability: str | None = None,
    positive: str | None = None,
) -> DataFrame:
    """One ``roc_auc`` row. With no bins the evaluator keeps every distinct score.

    It groups by score, range-partitions and sums per partition: exact, ties averaged,
    and distributed.
    """
    spark = predictions.sparkSession
    if task != BINARY:
        return spark.createDataFrame([("roc_auc", None, NOT_BINARY)], METRICS)
    if probability is None:
        return spark.createDataFrame([("roc_auc", None, NO_PROBABILITY)], METRICS)
    score = F.col(probability).cast("double")
    ends = predictions.agg(
        F.min(label).alias("low"), F.max(label).alias("high"),
        F.count_if(score.isNull() | F.isnan(score)).alias("bad")).first()
    if predictions.where(~F.col(label).isin(ends["low"], ends["high"])).head() is not None:
        return spark.createDataFrame([("roc_auc", None, NOT_BINARY)], METRICS)
    if ends["bad"]:
        return spark.createDataFrame([("roc_auc", None, BAD_PROBABILITY)], METRICS)
    if ends["low"] == ends["high"]:
        return spark.createDataFrame([("roc_auc", None, NO_PROBABILITY)], METRICS)
    wanted = ends["high"] if positive is None else positive
    scored = predictions.select(
        score.alias("score"),
        (F.col(label) == F.lit(wanted)).cast("double").alias("truth"))
    area = BinaryClassificationEvaluator(
        rawPredictionCol="score", labelCol="truth", metricName="areaUnderROC", numBins=0
    ).evaluate(scored)
    return spark.createDataFrame([("roc_auc", float(area), None)], METRICS).withColumn(
        "value", F.round("value", 6))


def regression_metrics(
    predictions: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """(metric, value, reason): MAE, MSE, RMSE and R2 from one aggregate."""
    y = F.col(label).cast("double")
    e = y - F.col(prediction).cast("double")
    n = F.col("n")
    totals = predictions.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
        F.var_pop(y).alias("spread"))
    # Without spread, a perfect prediction scores 1 and any other 0.
    flat = F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
    r2 = F.when(n >= 2, F.when(F.col("spread") == 0, flat).otherwise(
        1 - F.try_divide(F.col("mse"), F.col("spread"))))
    none = F.lit(None).cast("string")
    named = {"mae": F.col("mae"), "mse": F.col("mse"), "rmse": F.sqrt("mse"), "r2": r2}
    return totals.select(F.inline(F.array(*[
        F.struct(
            F.lit(name).alias("metric"), F.round(value, 6).alias("value"),
            (F.when(n < 2, TOO_FEW_ROWS) if name == "r2" else none).alias("reason"))
        for name, value in named.items()
    ])))
