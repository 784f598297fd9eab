"""Rule-based quality findings: predicates over the profile tables, no further scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.text import shown

# Fixed thresholds and words.
MISSING_WARNING = 20.0
MISSING_CRITICAL = 50.0
NEAR_CONSTANT_SHARE = 0.95
HIGH_CARDINALITY_SHARE = 0.5
MIXED_NUMERIC_LOW = 0.10
MIXED_NUMERIC_HIGH = 0.90
NONNEGATIVE_WORDS = ("age", "price", "amount", "quantity", "qty", "count", "total")

FINDINGS = (
    "dataset_id string, ordinal int, rule int, code string, severity string, "
    "column string, message string, metric double, details map<string,string>"
)


def _finding(
    rule: int,
    when: Column,
    code: str,
    severity: str | Column,
    message: Column,
    metric: Column | None = None,
    details: Column | None = None,
) -> Column:
    nothing = F.lit(None)
    return F.when(when, F.struct(
        F.lit(rule).alias("rule"),
        F.lit(code).alias("code"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        message.alias("message"),
        (nothing if metric is None else metric).cast("double").alias("metric"),
        (nothing if details is None else details).cast("map<string,string>").alias("details"),
    ))


def _missing_severity(share: Column, low: str) -> Column:
    return (
        F.when(share >= MISSING_CRITICAL, "critical")
        .when(share >= MISSING_WARNING, "warning")
        .otherwise(low)
    )


def _emit(table: DataFrame, findings: list[Column], ordinal: Column, column: Column):
    held = F.filter(F.array(*findings), lambda x: x.isNotNull())
    return table.select(
        "dataset_id", ordinal.cast("int").alias("ordinal"),
        column.cast("string").alias("column"), F.explode(held).alias("f"),
    ).select(
        "dataset_id", "ordinal", "f.rule", "f.code", "f.severity", "column", "f.message",
        "f.metric", "f.details",
    )


def dataset_findings(profile: DataFrame) -> DataFrame:
    """Findings about whole tables, from rows of ``dataset_profile``."""
    c = F.col
    some = c("column_count") > 0
    return _emit(profile, [
        _finding(1, ~some, "zero_columns", "critical",
                 F.lit("The table has no columns at all.")),
        _finding(2, some & (c("row_count") == 0), "empty_dataset", "info",
                 F.lit("The table has columns but not a single row.")),
        _finding(
            3, some & (c("duplicate_row_count") > 0), "duplicate_rows", "warning",
            F.format_string("Rows repeated beyond their first copy: %d.",
                            c("duplicate_row_count")),
            c("duplicate_row_count"),
            F.create_map(F.lit("duplicate_row_percentage"),
                         shown(c("duplicate_row_percentage")))),
        _finding(
            4, some & (c("total_missing_cells") > 0), "missing_values",
            _missing_severity(c("missing_percentage"), "info"),
            F.format_string("Missing cells: %d, which is %.4f%% of the table.",
                            c("total_missing_cells"), c("missing_percentage")),
            c("missing_percentage")),
    ], F.lit(-1), F.lit(None))


def column_findings(facts: DataFrame) -> DataFrame:
    """Findings about single columns; a column without any value has none.

    With an ``example`` column in ``facts``, constant columns report their value.
    """
    if "example" not in facts.columns:
        facts = facts.withColumn("example", F.lit(None).cast("string"))
    c = F.col
    held = c("non_null_count")
    top_share = F.try_divide(c("top_count").cast("double"), held)
    distinct_share = F.try_divide(c("unique_count").cast("double"), held)
    number_share = F.try_divide(c("number_like_count").cast("double"), held)
    kind = c("semantic_type")
    named = reduce(
        lambda a, b: a | b, (F.contains(F.lower("column"), F.lit(w)) for w in NONNEGATIVE_WORDS))
    percent = lambda share: F.round(share * 100, 4)
    return _emit(facts.where(held > 0), [
        _finding(
            5, c("null_percentage") >= MISSING_WARNING, "column_high_missing",
            _missing_severity(c("null_percentage"), "warning"),
            F.format_string("'%s' lacks %.4f%% of its values.", c("column"),
                            c("null_percentage")),
            c("null_percentage")),
        _finding(
            6, c("unique_count") == 1, "constant_column", "warning",
            F.format_string("'%s' holds one and the same value everywhere.", c("column")),
            None, F.create_map(F.lit("value"), c("example"))),
        _finding(
            7, (c("unique_count") >= 2) & (top_share >= NEAR_CONSTANT_SHARE),
            "near_constant_column", "info",
            F.format_string("One value makes up %.4f%% of '%s'.", percent(top_share),
                            c("column")),
            percent(top_share)),
        _finding(
            8, (kind == "categorical") & (distinct_share > HIGH_CARDINALITY_SHARE),
            "high_cardinality_categorical", "info",
            F.format_string("'%s' has %d different values in %d filled rows, many for a "
                            "category.", c("column"), c("unique_count"), held),
            percent(distinct_share)),
        _finding(
            9, (c("kind") == "string")
            & number_share.between(MIXED_NUMERIC_LOW, MIXED_NUMERIC_HIGH),
            "mixed_type_column", "warning",
            F.format_string("'%s' holds both numbers and other text; %.4f%% are numbers.",
                            c("column"), percent(number_share)),
            percent(number_share)),
        _finding(
            10, (kind == "numeric") & (c("infinite_count") > 0), "infinite_values",
            "critical",
            F.format_string("'%s' holds %d infinite values.", c("column"),
                            c("infinite_count")),
            c("infinite_count")),
        _finding(
            11, (kind == "numeric") & (c("negative_count") > 0) & named,
            "unexpected_negative_values", "warning",
            F.format_string("'%s' holds %d negative values, unexpected under this name.",
                            c("column"), c("negative_count")),
            c("negative_count")),
        _finding(
            12, (kind == "datetime") & (c("unparseable_count") > 0),
            "invalid_datetime_values", "warning",
            F.format_string("'%s' holds %d values that are no dates.", c("column"),
                            c("unparseable_count")),
            c("unparseable_count")),
    ], c("ordinal"), c("column"))


def quality_findings(profile: DataFrame, facts: DataFrame) -> DataFrame:
    """All findings; ``(ordinal, rule)`` is their order, dataset rules first.

    ``profile`` is ``dataset_profile`` and ``facts`` is ``column_facts`` with a
    ``dataset_id``; both may hold many datasets.
    """
    return dataset_findings(profile).unionAll(column_findings(facts))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("dataset_id", "severity").agg(
        F.count(F.lit(1)).alias("finding_count"))


def with_dataset(table: DataFrame, dataset_id: str) -> DataFrame:
    return table.withColumn("dataset_id", F.lit(dataset_id))
