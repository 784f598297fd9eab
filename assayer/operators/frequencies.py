"""How often each value of each column occurs: the base of every distinct-value result.

All columns go through one Generate and one hash aggregate. Values travel in three typed
slots (integer, floating, text), so numbers and times are grouped without first being
rendered as text; text is produced from the distinct values only. Equal values are
combined before the shuffle, so a value holding most of the rows is no hot key.

The code of a stack of many columns is too long for the JVM to compile. More than ``WIDE`` columns
go in blocks, each with its own stack and scan of its own columns; no value travels twice. Rows of
as many numbers are told apart by digests of the packed numbers, not of their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from assayer.errors import AssayError
from assayer.functions import predicates as P, text as X

TOP_VALUES = 10
# Text longer than this is grouped by its SHA-256 when the text itself is not needed.
DIGEST_ABOVE_BYTES = 64
# Columns that are stacked at once; of more, so many in a block.
WIDE = 32
BLOCK = 16

_NESTED = (T.ArrayType, T.MapType, T.StructType)


def _slots(field: T.StructField, digest: bool) -> tuple[Column, Column, Column]:
    """The column's value in its typed slot, NULL in the two others."""
    c = P.col(field.name)
    dtype = field.dataType
    no_int = F.lit(None).cast("bigint")
    no_float = F.lit(None).cast("double")
    no_text = F.lit(None).cast("string")
    if isinstance(dtype, P.INTEGRAL):
        return c.cast("bigint"), no_float, no_text
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("bigint"), no_float, no_text
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("bigint"), no_float, no_text
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")), no_float, no_text
    if isinstance(dtype, P.FLOATING):
        return no_int, P.as_double(field), no_text
    if isinstance(dtype, T.BinaryType):
        return no_int, no_float, F.sha2(c, 256)
    if isinstance(dtype, _NESTED):
        return no_int, no_float, F.sha2(F.to_json(F.struct(c.alias("v"))), 256)
    value = c.cast("string")
    if digest and P.is_string(dtype):
        # A digest is one byte longer than any text kept as it is: the two never mix.
        hashed = F.concat(F.lit("#"), F.sha2(value, 256))
        value = F.when(F.octet_length(value) > DIGEST_ABOVE_BYTES, hashed).otherwise(value)
    return no_int, no_float, value


def _text_of_slots(fields: list[tuple[int, T.StructField]]) -> Column:
    """Display text of a grouped value, by the type of its column."""
    ordinal, whole, real, word = (F.col(n) for n in ("ordinal", "v_int", "v_real", "v_text"))

    def ordinals(*types) -> list[int]:
        return [i for i, f in fields if isinstance(f.dataType, types)]

    rendered = F.coalesce(word, whole.cast("string"), real.cast("string"))
    for types, value in (
        (T.FloatType, real.cast("float").cast("string")),
        (T.BooleanType, (whole == 1).cast("string")),
        (T.DateType, F.date_from_unix_date(whole.cast("int")).cast("string")),
        ((T.TimestampType, T.TimestampNTZType), F.timestamp_micros(whole).cast("string")),
    ):
        hit = ordinals(*types) if isinstance(types, tuple) else ordinals(types)
        if hit:
            rendered = F.when(ordinal.isin(hit), value).otherwise(rendered)
    return rendered


def picked(df: DataFrame, columns: Iterable[str] | None) -> list[tuple[int, T.StructField]]:
    """Chosen columns with their place in the table; an unknown name is an error."""
    known = {f.name: (i, f) for i, f in enumerate(df.schema.fields)}
    names = list(known) if columns is None else list(columns)
    for name in names:
        if name not in known:
            raise AssayError("column_not_found", f"There is no column '{name}'.")
    return [known[name] for name in names]


def blocks(fields: list) -> list[list]:
    """The columns as one block, or of many columns blocks that are short to stack."""
    size = BLOCK if len(fields) > WIDE else max(len(fields), 1)
    return [fields[k:k + size] for k in range(0, len(fields), size)]


def grouped_values(
    df: DataFrame, columns: Iterable[str] | None = None, digest: bool = False
) -> DataFrame:
    """(ordinal, v_int, v_real, v_text, count) for all non-missing values."""
    fields = picked(df, columns)
    if not fields:
        return df.sparkSession.createDataFrame(
            [], "ordinal int, v_int bigint, v_real double, v_text string, count bigint")
    if len(fields) > WIDE:
        return reduce(DataFrame.unionAll, [
            grouped_values(df, [f.name for _, f in block], digest) for block in blocks(fields)])
    cells: list[Column] = []
    for i, field in fields:
        cells += [F.lit(i), *_slots(field, digest)]
    long = df.select(
        F.stack(F.lit(len(fields)), *cells).alias("ordinal", "v_int", "v_real", "v_text")
    )
    held = long.where(
        F.col("v_int").isNotNull() | F.col("v_real").isNotNull() | F.col("v_text").isNotNull())
    return held.groupBy("ordinal", "v_int", "v_real", "v_text").agg(
        F.count(F.lit(1)).alias("count")
    )


def _named(df: DataFrame) -> Column:
    return F.array(*[F.lit(name) for name in df.columns])[F.col("ordinal")]


def value_frequencies(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(ordinal, column, value, count): exact counts of every distinct value."""
    fields = picked(df, columns)
    return grouped_values(df, columns).select(
        "ordinal",
        _named(df).alias("column"),
        _text_of_slots(fields).alias("value"),
        "count",
    )


def frequency_summary(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Distinct values, highest and lowest count, and values held once, per column."""
    return (
        grouped_values(df, columns, digest=True)
        .groupBy("ordinal")
        .agg(
            F.count(F.lit(1)).alias("unique_count"),
            F.max("count").alias("top_count"),
            F.min("count").alias("bottom_count"),
            F.count_if(F.col("count") == 1).alias("rare_count"),
        )
    )


def top_values(
    df: DataFrame, columns: Iterable[str] | None = None, limit: int = TOP_VALUES
) -> DataFrame:
    """The most frequent values per column, ties by value, with the share of all rows.

    The rank filter becomes a group limit, which keeps only ``limit`` values per column
    and partition before the shuffle of the window.
    """
    fields = picked(df, columns)
    order = Window.partitionBy("ordinal").orderBy(F.col("count").desc(), F.col("value"))
    ranked = (
        value_frequencies(df, columns)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
    )
    rows = df.agg(F.count(F.lit(1)))
    return ranked.select(
        "column", F.col("rank").cast("int").alias("rank"), "value", "count",
        P.percentage(F.col("count"), rows.scalar()).alias("percentage"),
    )


def sample_values(
    df: DataFrame, order_by: list[str], columns: Iterable[str] | None = None, limit: int = 5
) -> DataFrame:
    """First non-missing values of each column in the caller's order, as text.

    One scan whatever the number of columns: all columns are stacked, and the rank filter
    becomes a group limit that keeps only ``limit`` values per column and partition before
    the shuffle.
    """
    fields = picked(df, columns)
    keys = [f"k{n}" for n, _ in enumerate(picked(df, order_by))]
    cells = [c for i, f in fields for c in (
        F.lit(i), F.when(P.present(f), X.value_text(f)))]
    stacked = df.select(
        *[P.col(k.name).alias(n) for n, (_, k) in zip(keys, picked(df, order_by))],
        F.stack(F.lit(len(fields)), *cells).alias("ordinal", "value"),
    ).where(F.col("value").isNotNull())
    order = Window.partitionBy("ordinal").orderBy(*keys, "value")
    return (
        stacked.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= limit)
        .select("ordinal", _named(df).alias("column"),
                F.col("position").cast("int").alias("position"), "value")
    )


def duplicate_groups(df: DataFrame, by_digest: bool | None = None) -> DataFrame:
    """One row per distinct row with its number of copies; nulls are equal.

    Wide rows are grouped by the SHA-256 of an unambiguous encoding of the row, so the
    shuffle carries 32 bytes per distinct row whatever the width of the table.
    """
    fields = df.schema.fields
    if by_digest is None:
        width = sum(_width(f.dataType) for f in fields)
        by_digest = width > 64 or any(isinstance(f.dataType, _NESTED) for f in fields)
    if not by_digest:
        keys = [_cell(f).alias(f"c{i}") for i, f in enumerate(fields)]
    else:
        numbers = [f for f in fields if isinstance(f.dataType, P.INTEGRAL + P.FLOATING)]
        packed = len(numbers) > WIDE
        parts = [F.lit("")]
        for f in fields:
            if packed and f in numbers:
                continue
            value = F.to_json(F.struct(_cell(f).alias("v"))) if isinstance(
                f.dataType, _NESTED) else (
                F.hex(_cell(f)) if isinstance(f.dataType, T.BinaryType)
                else _cell(f).cast("string"))
            sized = F.concat(F.length(value).cast("string"), F.lit(":"), value)
            parts.append(F.coalesce(sized, F.lit("~")))
        if packed:
            df = _digests(df, numbers, F.concat(*parts))
            keys = [F.col("c0")]
        else:
            keys = [F.unhex(F.sha2(F.concat(*parts), 256)).alias("c0")]
    return df.select(*keys).groupBy(*[f"c{i}" for i in range(len(keys))]).agg(
        F.count(F.lit(1)).alias("copies")
    )


def _packed(fields: list[T.StructField]) -> list[Column]:
    """Two arrays, of all whole numbers and of all others, with NULL where missing.

    Arrow takes an array of many numbers faster than as many columns.
    """
    whole = [_cell(f) for f in fields if isinstance(f.dataType, P.INTEGRAL)]
    real = [_cell(f) for f in fields if isinstance(f.dataType, P.FLOATING)]
    return [F.array(*cells).cast(f"array<{kind}>").alias(name) for name, kind, cells in (
        ("whole", "bigint", whole), ("real", "double", real))]


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Values by row and column, and which of them are missing, of either array."""
    for name in ("whole", "real"):
        flat = batch.column(batch.schema.get_field_index(name)).flatten()
        shape = (batch.num_rows, len(flat) // batch.num_rows)
        yield (flat.fill_null(0).to_numpy(zero_copy_only=False).reshape(shape),
               flat.is_null().to_numpy(zero_copy_only=False).reshape(shape))


def _digests(df: DataFrame, numbers: list[T.StructField], rest: Column) -> DataFrame:
    """(c0): the SHA-256 of each row: its numbers, which of them are missing, and the ``rest``."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [np.ascontiguousarray(part) for values, gaps in _unpacked(batch)
                     for part in (values, np.packbits(gaps, axis=1))]
            widths = [p.itemsize * p.shape[1] for p in parts]
            rows = np.concatenate([p.view(np.uint8).reshape(-1, w) for p, w in zip(
                parts, widths, strict=True) if w], axis=1)
            width, data = rows.shape[1], rows.tobytes()
            texts = batch.column(batch.schema.get_field_index("rest")).to_pylist()
            found = [hashlib.sha256(data[k * width:(k + 1) * width] + text).digest()
                     for k, text in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["c0"])

    return df.select(*_packed(numbers), F.encode(rest, "UTF-8").alias("rest")).mapInArrow(
        hashed, "c0 binary")


def duplicate_rows(df: DataFrame, by_digest: bool | None = None) -> DataFrame:
    """(row_count, duplicate_row_count): rows beyond the first of each distinct row."""
    if not df.columns:
        return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn(
            "duplicate_row_count", F.lit(0).cast("bigint"))
    return duplicate_groups(df, by_digest).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_row_count"),
    )


def _cell(field: T.StructField) -> Column:
    """NaN is missing and -0.0 equals 0.0 when whole rows are compared."""
    if isinstance(field.dataType, P.FLOATING):
        return P.as_double(field) + F.lit(0.0)
    return P.col(field.name)


def _width(dtype: T.DataType) -> int:
    if isinstance(dtype, (T.BooleanType, T.ByteType)):
        return 1
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return 24
    return 8
