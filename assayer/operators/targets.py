"""Which columns can be predicted, and by which task: projections of the column facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayer.errors import AssayError
from assayer.functions import predicates as P
from assayer.functions.text import shown

BINARY = "binary_classification"
MULTICLASS = "multiclass_classification"
REGRESSION = "regression"
TASKS = (BINARY, MULTICLASS, REGRESSION)
CLASSIFICATION = (BINARY, MULTICLASS)

# Fixed thresholds.
MAX_CLASSES = 20
MIN_ROWS = 10
MIN_SAMPLES_PER_CLASS = 2
MINORITY_SHARE = 0.05


def target_facts(facts: DataFrame) -> DataFrame:
    return facts.select(
        "ordinal", "column", "row_count", "non_null_count", "null_count", "unique_count",
        "raw_type", "semantic_type",
    )


def _suits() -> dict[str, Column]:
    enough = F.col("non_null_count") >= MIN_ROWS
    distinct = F.col("unique_count")
    return {
        BINARY: enough & (distinct == 2),
        MULTICLASS: enough & distinct.between(3, MAX_CLASSES),
        REGRESSION: enough & (F.col("semantic_type") == "numeric") & (distinct > 2),
    }


def task_suitability(facts: DataFrame) -> DataFrame:
    """(ordinal, column, task, suitable, reason): three verdicts for every column."""
    suits = _suits()
    held, distinct = F.col("non_null_count"), F.col("unique_count")
    few = held < MIN_ROWS
    too_few = F.format_string(
        f"%d filled target rows; training takes at least {MIN_ROWS}.", held)
    reasons = {
        BINARY: F.when(few, too_few)
        .when(distinct == 2, F.lit("There are exactly 2 different values."))
        .otherwise(F.format_string("Needs exactly 2 different values; there are %d.", distinct)),
        MULTICLASS: F.when(few, too_few)
        .when(distinct.between(3, MAX_CLASSES), F.format_string(
            f"There are %d different values, between 3 and {MAX_CLASSES}.", distinct))
        .otherwise(F.format_string(
            f"Needs 3 to {MAX_CLASSES} different values; there are %d.", distinct)),
        REGRESSION: F.when(few, too_few)
        .when(F.col("semantic_type") != "numeric", F.lit("Needs a numeric target."))
        .when(distinct > 2, F.lit("Numeric, with more than 2 different values."))
        .otherwise(F.lit("No more than 2 different numbers: a binary target.")),
    }
    verdicts = F.array(*[
        F.struct(F.lit(task).alias("task"), F.coalesce(suits[task], F.lit(False))
                 .alias("suitable"), reasons[task].alias("reason"))
        for task in TASKS
    ])
    return facts.select("ordinal", "column", F.inline(verdicts))


def suggested_task(facts: DataFrame) -> DataFrame:
    """(ordinal, column, suggested_task): the first suitable task, classification first."""
    suits = _suits()
    return facts.select(
        "ordinal", "column",
        F.coalesce(*[F.when(suits[t], F.lit(t)) for t in TASKS]).alias("suggested_task"),
    )


def target_validation(facts: DataFrame) -> DataFrame:
    """(ordinal, column, task, error, warnings) for every column and task.

    ``error`` is the first failing check in fixed order. A numeric target of two values
    is only warned about here, although it is not suggested for regression.
    """
    held, distinct = F.col("non_null_count"), F.col("unique_count")
    smallest = F.col("bottom_count")
    task = F.col("task")
    classes = task.isin(*CLASSIFICATION)
    share = F.try_divide(smallest.cast("double"), held)
    error = (
        F.when(held == 0, "target_all_missing")
        .when(held < MIN_ROWS, "insufficient_rows")
        .when(classes & (distinct == 1), "single_class_target")
        .when((task == BINARY) & (distinct != 2), "invalid_target_cardinality")
        .when((task == MULTICLASS) & ~distinct.between(3, MAX_CLASSES),
              "invalid_target_cardinality")
        .when(classes & (smallest < MIN_SAMPLES_PER_CLASS), "insufficient_class_samples")
        .when((task == REGRESSION) & (F.col("semantic_type") != "numeric"),
              "target_type_incompatible")
    )
    warnings = F.filter(F.array(
        F.when(classes & (share < MINORITY_SHARE), F.concat(
            F.lit("The smallest class of '"), F.col("column"), F.lit("' holds only "),
            shown(F.round(share * 100, 2), 2),
            F.lit("% of the rows; read accuracy with care."))),
        F.when((task == REGRESSION) & (distinct <= 2), F.format_string(
            "'%s' has only %d different numbers; a binary task may fit better.",
            F.col("column"), distinct)),
    ), lambda w: w.isNotNull())
    return (
        facts.withColumn("task", F.explode(F.array(*[F.lit(t) for t in TASKS])))
        .withColumn("error", error)
        .select("ordinal", "column", "task", "error",
                F.when(F.col("error").isNull(), warnings)
                .otherwise(F.array().cast("array<string>")).alias("warnings"))
    )


def validate_target(facts: DataFrame, target: str, task: str) -> list[str]:
    """Warnings for training on this target; a coded error when it cannot work."""
    if task not in TASKS:
        raise AssayError("invalid_task", f"There is no task '{task}'.")
    row = target_validation(facts).where(
        (F.col("column") == target) & (F.col("task") == task)).first()
    if row is None:
        raise AssayError("target_not_found", f"There is no column '{target}'.")
    if row["error"]:
        raise AssayError(row["error"], f"'{target}' cannot be the target of {task}.")
    return list(row["warnings"])


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """(label, count, percentage) of the rows with a target."""
    usable = usable_rows(df, target)
    counts = usable.groupBy(P.col(target).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    total = usable.agg(F.count(F.lit(1)))
    return counts.select(
        F.col("label").cast("string").alias("label"), "count",
        P.percentage(F.col("count"), total.scalar()).alias("percentage"),
    )


def usable_rows(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is present."""
    if target not in df.columns:
        raise AssayError("target_not_found", f"There is no column '{target}'.")
    return df.where(P.present(df.schema[target]))
