"""Bounded evidence rows drawn from profile tables of any number of datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from assayer.errors import AssayError
from assayer.operators.correlation import TOP_PAIRS, strength, strongest_pairs

# Fixed caps of what an evidence row may list.
SUMMARY_COLUMNS = 30
QUALITY_FINDINGS = 20

# Fields a model result must have.
MODEL_FIELDS = (
    "task_type", "target_column", "model_name", "feature_columns", "train_size",
    "test_size_actual", "metrics",
)
MODEL_TYPES = {
    "task_type": "string", "target_column": "string", "model_name": "string",
    "feature_columns": "array<string>", "train_size": "bigint",
    "test_size_actual": "bigint", "metrics": "map<string,double>",
    "unavailable_metrics": "map<string,string>", "warnings": "array<string>",
    "limitations": "array<string>",
}


def _first(table: DataFrame, limit: int, *order: str) -> DataFrame:
    """The first rows of each dataset in order, numbered; pruned before the shuffle."""
    window = Window.partitionBy("dataset_id").orderBy(*order)
    return table.withColumn("place", F.row_number().over(window)).where(F.col("place") <= limit)


def evidence_summary(
    profiles: DataFrame, facts: DataFrame, severities: DataFrame
) -> DataFrame:
    """One row per dataset: size, shares, findings by severity and its first columns."""
    count = F.col("finding_count")
    by_dataset = severities.groupBy("dataset_id").agg(
        F.sum(count).alias("quality_finding_count"),
        *[F.sum(F.when(F.col("severity") == s, count).otherwise(0)).alias(f"{s}_count")
          for s in ("critical", "warning", "info")])
    # At most ``SUMMARY_COLUMNS`` rows per dataset are gathered.
    columns = _first(facts, SUMMARY_COLUMNS, "ordinal").groupBy("dataset_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "place", "column", "semantic_type", "null_percentage", "unique_percentage")))
        .alias("columns"))
    return (
        profiles.join(by_dataset, "dataset_id", "left").join(columns, "dataset_id", "left")
        .select(
            "dataset_id", "row_count", "column_count", "missing_percentage",
            "duplicate_row_percentage",
            *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in (
                "quality_finding_count", "critical_count", "warning_count", "info_count")],
            F.coalesce("columns", F.array()).alias("columns"),
        )
    )


def evidence_quality(findings: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """The first findings of each dataset, with the count of all of them.

    ``profiles`` lists the datasets, so that one without findings has a row as well, with a
    count of 0 and no finding.
    """
    totals = findings.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("finding_count"))
    told = _first(findings, QUALITY_FINDINGS, "ordinal", "rule").join(totals, "dataset_id")
    if profiles is not None:
        told = profiles.select("dataset_id").distinct().join(told, "dataset_id", "left")
    return told.select(
        "dataset_id",
        F.coalesce("finding_count", F.lit(0).cast("bigint")).alias("finding_count"),
        F.col("place").cast("int").alias("place"), "code", "severity", "column", "message",
        "metric")


def evidence_column(profile: DataFrame, column: str) -> DataFrame:
    """The profile row of one column in every dataset that has it; a coded error if none."""
    found = profile.where(F.col("column") == column)
    if found.head() is None:
        raise AssayError("column_not_found", f"There is no column '{column}'.")
    return found


def evidence_correlation(pairs: DataFrame, limit: int = TOP_PAIRS) -> DataFrame:
    """The strongest pairs of each dataset with their strength in words."""
    return strongest_pairs(pairs, limit, by=["dataset_id"]).select(
        "dataset_id", F.col("rank").cast("int").alias("rank"), "column_a", "column_b",
        "coefficient", "observations", strength(F.col("coefficient")).alias("strength"))


def evidence_model(results: DataFrame, column: str = "result") -> DataFrame:
    """Model results given as JSON text, parsed, with the required fields they lack.

    The other input columns are kept. A text that is no JSON object lacks every field.
    """
    keys = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))
    wanted = F.array(*[F.lit(f) for f in MODEL_FIELDS])
    parsed = F.from_json(column, ", ".join(f"{n} {t}" for n, t in MODEL_TYPES.items()))
    others = [c for c in results.columns if c != column]
    return results.withColumns({
        "missing_fields": F.array_except(wanted, keys), "parsed": parsed,
    }).select(
        *others, "missing_fields",
        F.when(F.size("missing_fields") > 0, "ml_result_malformed").alias("error"),
        *[F.when(F.size("missing_fields") == 0, F.col(f"parsed.{name}")).alias(name)
          for name in MODEL_TYPES],
    )


def require_model_result(evidence: DataFrame) -> DataFrame:
    """The same table, or a coded error if any result lacks a field."""
    bad = evidence.where(F.col("error").isNotNull()).select("missing_fields").head()
    if bad is not None:
        raise AssayError("ml_result_malformed",
                         f"The model result lacks: {', '.join(bad['missing_fields'])}.")
    return evidence
