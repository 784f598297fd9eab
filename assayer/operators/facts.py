"""Column facts: one row per column, from one pass of plain aggregates.

Columns of one kind are stacked into (ordinal, value) and aggregated by ordinal. The
generated code is then the same for 5 or 500 columns, stays small enough to be compiled,
and partial results leave each task as one row per column. Every kind reads only its own
columns from a columnar source. Many columns of a kind are stacked in blocks.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayer.functions import predicates as P, text as X
from assayer.operators.frequencies import blocks, frequency_summary, picked

# Fixed widths in bytes for the size estimate; text and binary are measured.
FIXED_WIDTH = {
    "boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4,
    "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8,
}

# Fixed thresholds of the semantic types.
DATE_SHARE = 0.9
TEXT_UNIQUE_SHARE = 0.95
TEXT_UNIQUE_MINIMUM = 20

# Name and type of every single-pass statistic.
MEASURES = {
    "row_count": "bigint", "non_null_count": "bigint", "finite_count": "bigint",
    "min": "double", "max": "double", "mean": "double", "std": "double",
    "zero_count": "bigint", "negative_count": "bigint", "infinite_count": "bigint",
    "plain_integer_count": "bigint", "number_like_count": "bigint",
    "date_count": "bigint", "min_date": "timestamp", "max_date": "timestamp",
    "measured_bytes": "bigint",
}
COUNTS_OF_KIND = {
    "numeric": ("finite_count", "zero_count", "negative_count", "infinite_count"),
    "string": ("plain_integer_count", "number_like_count", "date_count"),
    "datetime": ("date_count",),
}


def kind_of(dtype: T.DataType) -> str:
    if P.is_boolean(dtype):
        return "boolean"
    if P.is_numeric(dtype):
        return "numeric"
    if P.is_temporal(dtype):
        return "datetime"
    if P.is_string(dtype):
        return "string"
    return "other"


def _cell(field: T.StructField, kind: str) -> Column:
    """What a column of this kind contributes to its stack; NULL when missing."""
    c = P.col(field.name)
    if kind == "numeric":
        return P.as_double(field)
    if kind == "datetime":
        return c.cast("timestamp")
    if kind == "string":
        return c.cast("string")
    if kind == "boolean":
        return c
    if isinstance(field.dataType, T.BinaryType):
        return F.octet_length(c)
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.when(c.isNotNull(), F.octet_length(F.to_json(F.struct(c.alias("v")))))
    return F.when(c.isNotNull(), F.lit(8))


def _measures(kind: str) -> dict[str, Column]:
    v = F.col("v")
    out = {"row_count": F.count(F.lit(1)), "non_null_count": F.count(v)}
    if kind == "numeric":
        real = F.when(F.abs(v) < float("inf"), v)
        out |= {
            "finite_count": F.count(real), "min": F.min(real), "max": F.max(real),
            "mean": F.avg(real), "std": F.stddev_samp(real),
            "zero_count": F.count_if(v == 0), "negative_count": F.count_if(v < 0),
            "infinite_count": F.count_if(P.is_infinite(v)),
        }
    elif kind == "datetime":
        out |= {"date_count": F.count(v), "min_date": F.min(v), "max_date": F.max(v)}
    elif kind == "string":
        date, plain = F.col("date"), F.col("plain")
        out |= {
            "plain_integer_count": F.count_if(plain),
            "number_like_count": F.count_if(plain | X.number_like(v)),
            "date_count": F.count(date), "min_date": F.min(date), "max_date": F.max(date),
            "measured_bytes": F.sum(F.octet_length(v).cast("bigint")),
        }
    elif kind == "other":
        out["measured_bytes"] = F.sum(v.cast("bigint"))
    return out


def column_stats(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row per column with every single-pass statistic (see ``MEASURES``)."""
    fields = picked(df, columns)
    by_kind: dict[str, list[tuple[int, T.StructField]]] = {}
    for i, field in fields:
        by_kind.setdefault(kind_of(field.dataType), []).append((i, field))
    parts = []
    for kind, members in [(k, b) for k, m in by_kind.items() for b in blocks(m)]:
        cells = [c for i, f in members for c in (F.lit(i), _cell(f, kind))]
        long = df.select(F.stack(F.lit(len(members)), *cells).alias("ordinal", "v"))
        if kind == "string":
            long = X.with_timestamp(long, F.col("v"), "date").withColumn(
                "plain", F.col("v").rlike(X.PLAIN_INTEGER))
        known = _measures(kind)
        parts.append(long.groupBy("ordinal").agg(
            *[known.get(name, F.lit(None)).cast(dtype).alias(name)
              for name, dtype in MEASURES.items()]))
    described = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString(), kind_of(f.dataType),
          FIXED_WIDTH.get(f.dataType.simpleString(), _decimal_width(f.dataType)))
         for i, f in fields],
        "ordinal int, column string, raw_type string, kind string, width int")
    if not parts:
        return _filled(described.withColumns({
            name: F.lit(None).cast(dtype) for name, dtype in MEASURES.items()}))
    # An empty table has no groups: the list of columns keeps their rows.
    return _filled(described.join(reduce(DataFrame.unionAll, parts), "ordinal", "left"))


def _decimal_width(dtype: T.DataType) -> int | None:
    if isinstance(dtype, T.DecimalType):
        return 8 if dtype.precision <= 18 else 16
    return None


def _filled(joined: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    filled = joined.withColumns({
        name: F.coalesce(name, zero) for name in ("row_count", "non_null_count")
    }).withColumns({
        name: F.when(F.col("kind").isin(*[k for k, v in COUNTS_OF_KIND.items() if name in v]),
                     F.coalesce(name, zero))
        for name in {n for names in COUNTS_OF_KIND.values() for n in names}
    })
    return filled.withColumns({
        "null_count": F.col("row_count") - F.col("non_null_count"),
        "logical_bytes": F.coalesce(
            F.col("measured_bytes"), F.col("non_null_count") * F.col("width"), zero),
    }).drop("width", "measured_bytes")


def semantic_type() -> Column:
    """Semantic type from column facts; needs ``unique_count`` beside ``column_stats``."""
    kind, held = F.col("kind"), F.col("non_null_count")
    plain = F.try_divide(F.col("plain_integer_count"), held)
    dated = F.try_divide(F.col("date_count"), held)
    distinct = F.try_divide(F.col("unique_count"), F.col("row_count"))
    return (
        F.when(kind.isin("boolean", "numeric", "datetime"), kind)
        .when((kind == "string") & (plain < DATE_SHARE) & (dated >= DATE_SHARE), "datetime")
        .when(
            (kind == "string") & (distinct >= TEXT_UNIQUE_SHARE)
            & (F.col("unique_count") >= TEXT_UNIQUE_MINIMUM),
            "text",
        )
        .when(kind == "string", "categorical")
        .otherwise("unknown")
    )


def column_facts(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    counted: Iterable[str] | None = None,
) -> DataFrame:
    """``column_stats`` with exact distinct counts and the semantic type.

    ``counted`` limits the distinct counts, the only part that shuffles values, to some
    columns; the others have none. The join is between two tables of one row per column.
    """
    columns = None if columns is None else list(columns)
    tallied = [(i, f) for i, f in picked(df, columns if counted is None else counted)]
    summary = frequency_summary(df, [f.name for _, f in tallied])
    joined = column_stats(df, columns).join(summary, "ordinal", "left")
    known = F.col("ordinal").isin([i for i, _ in tallied])
    zero = F.lit(0).cast("bigint")
    return joined.withColumns({
        name: F.when(known, F.coalesce(F.col(name), zero))
        for name in ("unique_count", "top_count", "bottom_count", "rare_count")
    }).withColumns({
        "semantic_type": semantic_type(),
        "null_percentage": P.percentage(F.col("null_count"), F.col("row_count")),
        "unique_percentage": F.when(known, P.percentage(
            F.col("unique_count"), F.col("non_null_count"))),
        "unparseable_count": F.when(
            F.col("kind").isin("string", "datetime"),
            F.col("non_null_count") - F.col("date_count")),
    })


def column_examples(df: DataFrame) -> DataFrame:
    """(ordinal, example): the smallest value as text; of a constant column, its value."""
    fields = [(i, f) for i, f in enumerate(df.schema.fields) if kind_of(f.dataType) != "other"]
    if not fields:
        return df.sparkSession.createDataFrame([], "ordinal int, example string")
    return reduce(DataFrame.unionAll, [_least(df, block) for block in blocks(fields)])


def _least(df: DataFrame, fields: list[tuple[int, T.StructField]]) -> DataFrame:
    least = df.agg(*[
        F.min(F.when(P.present(f), P.col(f.name))).alias(f"m{i}") for i, f in fields])
    return least.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("ordinal"),
                 X.value_text(T.StructField(f"m{i}", f.dataType)).alias("example"))
        for i, f in fields
    ])))
