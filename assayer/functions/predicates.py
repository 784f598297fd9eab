"""Null, NaN and infinity rules, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def col(name: str) -> Column:
    """Reference a column whose name may hold dots, blanks or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_string(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_boolean(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.BooleanType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, TEMPORAL)


def missing(field: T.StructField) -> Column:
    """NULL and NaN both count as missing."""
    c = col(field.name)
    if isinstance(field.dataType, FLOATING):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def present(field: T.StructField) -> Column:
    return ~missing(field)


def as_double(field: T.StructField) -> Column:
    """The numeric value as double, with missing values as NULL. Infinities stay."""
    c = col(field.name).cast("double")
    if isinstance(field.dataType, FLOATING):
        return F.nanvl(c, F.lit(None).cast("double"))
    return c


def is_infinite(c: Column) -> Column:
    return F.abs(c) == F.lit(float("inf"))


def finite(field: T.StructField) -> Column:
    """The numeric value as double, NULL when missing or infinite."""
    c = col(field.name).cast("double")
    if isinstance(field.dataType, FLOATING):
        # NaN sorts above infinity, so one comparison drops both.
        return F.when(F.abs(c) < F.lit(float("inf")), c)
    return c


def percentage(part: Column, whole: Column, digits: int = 4) -> Column:
    """``part / whole * 100`` rounded; 0 when the denominator is 0."""
    share = F.try_divide(part.cast("double"), whole.cast("double"))
    return F.coalesce(F.round(share * 100, digits), F.lit(0.0))


def numeric_fields(schema: T.StructType) -> list[T.StructField]:
    """Numeric columns in schema order; booleans are not numeric."""
    return [f for f in schema.fields if is_numeric(f.dataType)]
