"""Column and dataset profiles: projections of the column facts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions import predicates as P
from assayer.operators import frequencies as V
from assayer.operators.facts import column_facts, column_stats
from assayer.operators.quantiles import quantiles


def missing_cells(df: DataFrame) -> DataFrame:
    """One row: missing cells of the whole table, nothing else."""
    total = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        total = total + F.count_if(P.missing(field))
    return df.agg(total.alias("missing_value_count"))


def structural_facts(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells and duplicate rows."""
    return V.duplicate_rows(df).select(
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        missing_cells(df).scalar().alias("missing_value_count"),
        "duplicate_row_count",
    )


def numeric_profile(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """min, max, mean, std, quartiles and zero/negative/infinite counts per column."""
    names = [f.name for _, f in V.picked(df, columns) if P.is_numeric(f.dataType)]
    stats = column_stats(df, names)
    ranks = quantiles(df, names).select("ordinal", "quantiles")
    return with_quartiles(stats, ranks).select(
        "column", "row_count", "null_count", "min", "max", "mean", "median", "std",
        "q1", "q3", "iqr", "zero_count", "negative_count", "infinite_count",
    )


def with_quartiles(stats: DataFrame, ranks: DataFrame) -> DataFrame:
    """Attach quartiles; both sides hold one row per column."""
    q = F.col("quantiles")
    return stats.join(ranks, "ordinal", "left").withColumns({
        "q1": q[0], "median": q[1], "q3": q[2], "iqr": q[2] - q[0],
    }).drop("quantiles")


def column_common(facts: DataFrame) -> DataFrame:
    return facts.select(
        "ordinal", "column", "raw_type", "semantic_type", "null_count", "null_percentage",
        "unique_count", "unique_percentage",
    )


def semantic_types(facts: DataFrame) -> DataFrame:
    held = F.col("non_null_count")
    return facts.select(
        "ordinal", "column", "raw_type", "semantic_type",
        F.round(F.try_divide(F.col("plain_integer_count"), held), 6).alias("integer_share"),
        F.round(F.try_divide(F.col("date_count"), held), 6).alias("date_share"),
    )


def categorical_profile(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("semantic_type").isin("categorical", "text")).select(
        "column", "semantic_type", F.col("unique_count").alias("cardinality"),
        F.col("rare_count").alias("rare_value_count"),
    )


def date_range_days() -> Column:
    span = F.unix_micros("max_date") - F.unix_micros("min_date")
    return span / F.lit(86_400_000_000.0)


def datetime_profile(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("semantic_type") == "datetime").select(
        "column", "min_date", "max_date", date_range_days().alias("date_range_days"),
        F.col("null_count").alias("missing_count"), "unparseable_count",
    )


def missing_summary(facts: DataFrame) -> DataFrame:
    """Missing cells over the whole table, from the facts of its columns."""
    cells = F.sum("row_count")
    total = F.coalesce(F.sum("null_count"), F.lit(0))
    return facts.agg(
        total.alias("total_missing_cells"),
        P.percentage(total, cells).alias("missing_percentage"),
        F.count_if(F.col("null_count") > 0).alias("columns_with_missing"),
    )


def logical_size(stats: DataFrame) -> DataFrame:
    """Estimated bytes per column: fixed widths of held values, measured text."""
    return stats.select("column", "raw_type", "logical_bytes")


def eligible_columns(df: DataFrame) -> DataFrame:
    """Which columns count as numeric for correlation and histograms."""
    rows = [(i, f.name, P.is_numeric(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "ordinal int, column string, eligible boolean")


def column_profile(
    df: DataFrame,
    dataset_id: str,
    facts: DataFrame | None = None,
    order_by: list[str] | None = None,
) -> DataFrame:
    """One row per column: common facts and at most one block of statistics.

    ``order_by`` gives the samples their order; without it there are none.
    """
    facts = column_facts(df) if facts is None else facts
    numeric = [f.name for f in P.numeric_fields(df.schema)]
    ranks = quantiles(df, numeric).select("ordinal", "quantiles")
    full = with_quartiles(facts, ranks)
    words = [f.name for f in df.schema.fields if P.is_string(f.dataType)]
    if words:
        best = V.top_values(df, words).groupBy("column").agg(
            F.array_sort(F.collect_list(F.struct("rank", "value", "count", "percentage")))
            .alias("top_values"))
        full = full.join(best, "column", "left")
    else:
        full = full.withColumn("top_values", F.lit(None).cast(
            "array<struct<rank:int,value:string,count:bigint,percentage:double>>"))
    if order_by:
        samples = V.sample_values(df, order_by).groupBy("column").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))),
                        lambda s: s["value"]).alias("sample_values"))
        full = full.join(samples, "column", "left")
    else:
        full = full.withColumn("sample_values", F.lit(None).cast("array<string>"))
    kind = F.col("semantic_type")
    return full.select(
        F.lit(dataset_id).alias("dataset_id"), "ordinal", "column", "raw_type",
        "semantic_type", "row_count", "non_null_count", "null_count", "null_percentage",
        "unique_count", "unique_percentage", "sample_values",
        F.when(kind == "numeric", F.struct(
            "min", "max", "mean", "median", "std", "q1", "q3", "iqr", "zero_count",
            "negative_count", "infinite_count")).alias("numeric_stats"),
        F.when(kind.isin("categorical", "text"), F.struct(
            F.col("unique_count").alias("cardinality"),
            F.coalesce("top_values", F.array()).alias("top_values"),
            F.col("rare_count").alias("rare_value_count"))).alias("categorical_stats"),
        F.when(kind == "datetime", F.struct(
            "min_date", "max_date", date_range_days().alias("date_range_days"),
            F.col("null_count").alias("missing_count"), "unparseable_count")
        ).alias("datetime_stats"),
    )


def dataset_profile(df: DataFrame, dataset_id: str, facts: DataFrame) -> DataFrame:
    """One row: size, missing values, duplicates and the size estimate."""
    doubles = V.duplicate_rows(df).select("duplicate_row_count")
    if not df.columns:
        totals = df.agg(F.count(F.lit(1)).alias("row_count")).withColumns({
            "total_missing_cells": F.lit(0).cast("bigint"),
            "columns_with_missing": F.lit(0).cast("bigint"),
            "logical_bytes": F.lit(0).cast("bigint")})
    else:
        totals = facts.agg(
            F.max("row_count").alias("row_count"),
            F.sum("null_count").alias("total_missing_cells"),
            F.count_if(F.col("null_count") > 0).alias("columns_with_missing"),
            F.sum("logical_bytes").alias("logical_bytes"),
        )
    width = F.lit(len(df.columns))
    return totals.withColumn("duplicate_row_count", doubles.scalar()).select(
        F.lit(dataset_id).alias("dataset_id"), "row_count",
        width.alias("column_count"), "logical_bytes", "duplicate_row_count",
        P.percentage(F.col("duplicate_row_count"), F.col("row_count"))
        .alias("duplicate_row_percentage"),
        "total_missing_cells",
        P.percentage(F.col("total_missing_cells"), F.col("row_count") * width)
        .alias("missing_percentage"),
        "columns_with_missing",
    )
