"""Transparent baseline models on Spark ML, trained and compared on one split."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from assayer.errors import AssayError
from assayer.functions import predicates as P
from assayer.operators import evaluate as E, forest, linear
from assayer.operators.facts import column_facts
from assayer.operators.features import (
    FeatureSelection, as_selection, counted_columns, feature_selection, training_warnings,
)
from assayer.operators.preprocess import FEATURES, Preprocessor, fit_preprocessor
from assayer.operators.split import check_split_sizes, split_table
from assayer.operators.targets import (
    BINARY, CLASSIFICATION, MULTICLASS, REGRESSION, usable_rows, validate_target,
)

LABEL = "label_value"

LIMITATIONS = (
    "A baseline: no hyperparameter was tuned.",
    "Free text and dates are no features.",
)


@dataclass(frozen=True)
class TrainingSet:
    """Rows with features and label, split once for all models of a comparison."""

    train: DataFrame
    test: DataFrame
    task: str
    target: str
    classes: list
    selection: FeatureSelection
    preprocessor: Preprocessor
    warnings: list[str]
    train_size: int
    test_size: int
    test_share: float
    seed: int
    kept: tuple[DataFrame, ...]

    def unpersist(self) -> None:
        for table in (self.train, self.test, *self.kept):
            table.unpersist()


def _logistic(data: TrainingSet):
    """L2 penalty of weight 1 on the summed loss, hence 1/n on Spark's mean loss."""
    return _Logistic(LogisticRegression(
        featuresCol=FEATURES, labelCol=LABEL, maxIter=1000, tol=1e-8,
        regParam=1.0 / data.train_size, elasticNetParam=0.0, standardization=False,
    ).fit(data.train))


class _Logistic:
    """A model of Spark ML behind the interface of those that are fitted here."""

    def __init__(self, model) -> None:
        self.model = model

    def transform(self, rows: DataFrame, features: str) -> DataFrame:
        return self.model.transform(rows)


def _linear(data: TrainingSet):
    return linear.fit(data.train, FEATURES, LABEL)


def _ridge(data: TrainingSet):
    return linear.fit(data.train, FEATURES, LABEL, penalty=1.0)


# None stands for forests, which are grown here.
_CLASSIFIERS: dict[str, Callable | None] = {
    "logistic_regression": _logistic,
    "random_forest_classifier": None,
}
_REGRESSORS: dict[str, Callable | None] = {
    "linear_regression": _linear,
    "ridge_regression": _ridge,
    "random_forest_regressor": None,
}
MODELS = {BINARY: _CLASSIFIERS, MULTICLASS: _CLASSIFIERS, REGRESSION: _REGRESSORS}


def supported_models(task: str) -> list[str]:
    return list(MODELS[task])


def prepare_training(
    df: DataFrame,
    target: str,
    task: str,
    keys: list[str],
    test_share: float = 0.2,
    seed: int = 42,
) -> TrainingSet:
    """Validate, drop rows without target, select, split, then learn the transforms.

    ``keys`` identify a row for the split and are no features. The usable rows are kept, so
    that what ``df`` is made of is read once; ``unpersist`` releases them.
    """
    if target not in df.columns:
        raise AssayError("target_not_found", f"There is no column '{target}'.")
    usable = usable_rows(df, target).persist()
    candidates = [c for c in df.columns if c == target or c not in keys]
    facts = column_facts(
        usable, candidates, counted_columns(usable, target, keys)).persist()
    try:
        warnings = validate_target(facts, target, task)
        row_count = facts.first()["row_count"]
        # One row per column: from here on the choice is known to the driver.
        rows = feature_selection(usable, target, facts).collect()
    finally:
        facts.unpersist()
    selection = as_selection(rows)
    if not selection.columns:
        raise AssayError("no_usable_features", "No column is left to learn from.")
    chosen = df.sparkSession.createDataFrame(
        rows, "ordinal int, column string, role string, reason string, unique_count bigint")
    warnings += [r["warning"] for r in training_warnings(chosen, row_count)
                 .orderBy("ordinal").collect()]
    check_split_sizes(row_count, test_share)

    label = target if task in CLASSIFICATION else None
    needed = usable.select(*[
        P.col(c) for c in dict.fromkeys([*keys, target, *selection.columns])])
    parts = split_table(needed, keys, test_share, seed, label)
    value, classes = _label(usable, target, task)
    marked = parts.withColumn(LABEL, value).persist()
    train, test = marked.where(~F.col("is_test")), marked.where(F.col("is_test"))
    fitted = fit_preprocessor(train, selection)
    sizes = marked.groupBy("is_test").agg(F.count(F.lit(1)).alias("n")).collect()
    by_side = {r["is_test"]: r for r in sizes}
    if len(by_side) < 2:
        raise AssayError("invalid_split_configuration", "One side of the split is empty.")
    kept = [*[P.col(k) for k in dict.fromkeys(keys)], P.col(target).alias("label"),
            F.col(LABEL), F.col(FEATURES)]
    return TrainingSet(
        fitted.transform(train).select(*kept).persist(),
        fitted.transform(test).select(*kept).persist(),
        task, target, classes, selection, fitted, warnings,
        by_side[False]["n"], by_side[True]["n"],
        test_share, seed, (usable, marked))


def _label(df, target, task):
    """The label as a number; classes are numbered in their natural order."""
    if task == REGRESSION:
        return P.col(target).cast("double"), []
    # At most twenty classes: validation has already counted them.
    classes = sorted(r[0] for r in df.select(P.col(target)).distinct().collect())
    number = F.lit(None).cast("double")
    for place, value in enumerate(classes):
        number = F.when(P.col(target) == F.lit(value), float(place)).otherwise(number)
    return number, classes


def predict(
    data: TrainingSet, name: str, seed: int = 42, depth: int | None = None, on: str = "test"
) -> DataFrame:
    """Test rows as (keys, label, prediction[, probability]); fitted on training rows.

    ``probability`` is that of the greater of two classes. ``on`` chooses other rows:
    "train", or "both" with a column ``is_test``. Trees have no limit of depth unless ``depth``
    sets one.
    """
    models = MODELS[data.task]
    if name not in models:
        raise AssayError(
            "invalid_model_for_task",
            f"'{name}' does not fit {data.task}; choose from {', '.join(models)}.")
    rows = data.train if on == "train" else data.test
    if on == "both":
        rows = data.test.withColumn("is_test", F.lit(True)).unionByName(
            data.train.withColumn("is_test", F.lit(False)))
    votes = F.col("_votes")
    if models[name] is None:
        grown = forest.grow(
            data.train, FEATURES, LABEL, _keys(data), len(data.classes),
            all_features=data.task == REGRESSION, seed=seed, depth=depth)
        rows = grown.predict(rows, FEATURES, "_votes")
        best = votes[0] if data.task == REGRESSION else (
            F.array_position(votes, F.array_max(votes)) - 1)
    else:
        rows = models[name](data).transform(rows, FEATURES)
        best = F.col("prediction")
        if data.task == BINARY:
            votes = vector_to_array("probability")
    return _scored(data, rows, best, votes)


def _keys(data: TrainingSet) -> list[str]:
    return [c for c in data.test.columns if c not in ("label", LABEL, FEATURES)]


def _scored(data: TrainingSet, rows: DataFrame, best: Column, votes: Column) -> DataFrame:
    columns = [*[P.col(k) for k in _keys(data)], F.col("label")]
    columns += [F.col("is_test")] if "is_test" in rows.columns else []
    if data.task == REGRESSION:
        return rows.select(*columns, best.alias("prediction"))
    named = F.array(*[F.lit(c) for c in data.classes])
    columns.append(named[best.cast("int")].alias("prediction"))
    if data.task == BINARY:
        columns.append(votes[1].alias("probability"))
    return rows.select(*columns)


def model_metrics(data: TrainingSet, predictions: DataFrame) -> DataFrame:
    if data.task == REGRESSION:
        return E.regression_metrics(predictions)
    return E.classification_metrics(
        predictions, data.task,
        probability="probability" if data.task == BINARY else None)


def compare_models(
    data: TrainingSet, names: list[str] | None = None, seed: int = 42,
    depth: int | None = None,
) -> DataFrame:
    """(model, metric, value, reason, sizes) for each model on the same split; no winner."""
    result = None
    for name in names or supported_models(data.task):
        rows = model_metrics(data, predict(data, name, seed, depth)).select(
            F.lit(name).alias("model"), "metric", "value", "reason",
            F.lit(data.train_size).cast("bigint").alias("train_size"),
            F.lit(data.test_size).cast("bigint").alias("test_size"))
        result = rows if result is None else result.unionAll(rows)
    return result


def model_result(
    data: TrainingSet, name: str, dataset_id: str, metrics: DataFrame,
    predictions: DataFrame | None = None, depth: int | None = None,
) -> DataFrame:
    """One row describing a training run, ready for ``evidence``.

    With the ``predictions`` of a classifier it holds their confusion matrix.
    """
    spark = metrics.sparkSession
    rows = metrics.collect()
    # A square of at most twenty classes.
    matrix = None
    if predictions is not None and data.task in CLASSIFICATION:
        matrix = [tuple(r) for r in E.confusion_matrix(predictions)
                  .orderBy("label", "prediction").collect()]
    return spark.createDataFrame(
        [(dataset_id, data.target, data.task, name, data.selection.columns,
          data.selection.excluded, data.selection.transforms, data.train_size, data.test_size,
          data.test_share, data.seed, data.task in CLASSIFICATION,
          depth,
          {r["metric"]: r["value"] for r in rows if r["value"] is not None},
          {r["metric"]: r["reason"] for r in rows if r["value"] is None}, matrix,
          list(data.warnings), list(LIMITATIONS))],
        "dataset_id string, target_column string, task_type string, model_name string, "
        "feature_columns array<string>, excluded_columns map<string,string>, "
        "transforms map<string,string>, train_size bigint, test_size_actual bigint, "
        "test_share double, seed bigint, stratified boolean, depth bigint, "
        "metrics map<string,double>, unavailable_metrics map<string,string>, "
        "confusion_matrix array<struct<label:string,prediction:string,count:bigint>>, "
        "warnings array<string>, limitations array<string>")
