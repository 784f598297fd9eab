"""Delimited text: headers, ragged rows, encodings, missing-value words and types."""

from __future__ import annotations

import csv
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from assayer.errors import AssayError
from assayer.functions import predicates as P, text as X
from assayer.sources.records import records

CORRUPT = "_corrupt_line"
QUOTED = r'"([^"]|"")*"'


@dataclass(frozen=True)
class Layout:
    """How the text is to be read; found by one scan of the raw lines."""

    encoding: str
    multi_line: bool


def detect_layouts(
    spark: SparkSession, path: str, separator: str = ","
) -> dict[Layout, list[str]]:
    """Files by how each is to be read, from one scan of the raw lines.

    A file is UTF-8 unless some line of it is not valid UTF-8, then Latin-1. A line with an
    odd number of quotes means that a quoted field may span lines; such a file is cut into
    records by ``records``. All files must have the same header. One row per file comes to the
    driver, which lists the files in any case.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"))
    seen = lines.groupBy("file").agg(
        F.count_if(~F.is_valid_utf8("value")).alias("foreign"),
        F.count_if(F.regexp_count("value", F.lit('"')) % 2 == 1).alias("open"),
        # The lines of a file's first block come in order from one task.
        F.first(F.when(F.col("start") == 0, F.col("value").cast("binary")), True)
        .alias("header"),
    ).collect()
    if not seen:
        raise AssayError("empty_file", "The file holds nothing.")
    found: dict[Layout, list[str]] = {}
    headers = set()
    for r in sorted(seen, key=lambda r: r["file"]):
        layout = Layout("ISO-8859-1" if r["foreign"] else "UTF-8", r["open"] > 0)
        found.setdefault(layout, []).append(unquote(r["file"]))
        line = bytes(r["header"] or b"").decode(layout.encoding).removeprefix("\ufeff")
        if line.count('"') % 2 == 0:
            headers.add(tuple(next(csv.reader([line], delimiter=separator), [])))
    if len(headers) > 1:
        raise AssayError("malformed_csv", "The files have different headers.")
    return found


def detect_layout(spark: SparkSession, path: str) -> Layout:
    """The layout of a file, or of a folder whose files have the same one."""
    found = list(detect_layouts(spark, path))
    if len(found) > 1:
        raise AssayError("mixed_layouts", "The files are to be read in different ways.")
    return found[0]


def _reader(spark, layout, separator):
    return (
        spark.read.option("sep", separator).option("quote", '"').option("escape", '"')
        .option("encoding", layout.encoding).option("multiLine", layout.multi_line)
    )


def read_header(
    spark: SparkSession, path: str | list[str], layout: Layout, separator: str = ","
) -> list[str]:
    """Column names from the first line; repeated names are numbered."""
    row = _reader(spark, layout, separator).csv(path).head()
    if row is None:
        raise AssayError("empty_file", "The file has no header.")
    names, taken = [], {}
    for i, raw in enumerate(row):
        name = (raw or "").removeprefix("﻿") or f"Unnamed: {i}"
        plain = name
        while name in taken:
            taken[plain] += 1
            name = f"{plain}.{taken[plain]}"
        taken[name] = 0
        names.append(name)
    return names


def read_text(
    spark: SparkSession, path: str, layout: Layout | None = None, separator: str = ","
) -> DataFrame:
    """All columns as text, and the raw line of every row of unexpected length."""
    if layout is not None:
        return _read_group(spark, path, layout, separator)
    groups = detect_layouts(spark, path, separator)
    return reduce(DataFrame.unionByName, (
        _read_group(spark, files, own, separator) for own, files in groups.items()))


def _read_group(spark, path: str | list[str], layout: Layout, separator: str) -> DataFrame:
    names = read_header(spark, path, layout, separator)
    schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in [*names, CORRUPT])
    if layout.multi_line:
        options = {"sep": separator, "quote": '"', "escape": '"', "mode": "PERMISSIVE",
                   "multiLine": "true", "columnNameOfCorruptRecord": CORRUPT}
        rows = records(spark, path, layout.encoding, separator)
        return rows.select(F.from_csv("record", F.lit(schema), options).alias("r")).select("r.*")
    return (
        _reader(spark, layout, separator)
        .option("header", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        # A parser that skips columns does not see the length of a line.
        .option("columnPruning", False)
        .schema(schema).csv(path)
    )


def malformed_rows(text: DataFrame, separator: str = ",") -> DataFrame:
    """(line, field_count) of rows with more fields than the header.

    Shorter rows are no error: their last columns are missing.
    """
    expected = len(text.columns) - 1
    bare = F.regexp_replace(CORRUPT, QUOTED, "")
    # The parser notices odd lines only while it reads some column: name one as well.
    counted = F.regexp_count(bare, F.lit("\\Q" + separator + "\\E")) + 1
    count = F.coalesce(counted, F.length(P.col(text.columns[0])))
    return text.where(F.col(CORRUPT).isNotNull()).select(
        F.col(CORRUPT).alias("line"), count.alias("field_count")
    ).where(F.col("field_count") > expected)


def normalise_missing(text: DataFrame) -> DataFrame:
    """Text columns with every missing-value word as NULL."""
    return text.select(*[
        X.null_tokens_to_null(P.col(f.name)).alias(f.name) if P.is_string(f.dataType)
        else P.col(f.name) for f in text.schema.fields if f.name != CORRUPT
    ])


def infer_types(text: DataFrame) -> DataFrame:
    """(ordinal, column, inferred_type, row_count, non_null_count) of text columns.

    The narrowest of bigint, decimal(20,0), double and boolean that holds every value,
    else string. A column without any value is double, as long as there are rows.
    """
    fields = text.schema.fields
    cells = [c for i, f in enumerate(fields) for c in (F.lit(i), P.col(f.name))]
    v, trimmed, form = F.col("v"), F.trim("v"), F.col("form")
    digits = F.length(F.regexp_replace(trimmed, "^[+-]?0*", ""))
    # Each value is classified once; the columns then only count forms. Lengths decide
    # most whole numbers without a cast that may fail.
    forms = (
        F.when(v.isNull(), None)
        .when(v.rlike(X.SIGNED_INTEGER), F.when(F.length(trimmed) <= 18, "long")
              .when(digits > 20, "digits")
              .when(trimmed.try_cast("bigint").isNotNull(), "long")
              .when(trimmed.try_cast("decimal(20,0)").isNotNull(), "decimal")
              .otherwise("digits"))
        .when(v.rlike(X.DECIMAL_NUMBER) | v.rlike(X.INFINITE_NUMBER), "number")
        .when(v.isin(*X.TRUE_WORDS, *X.FALSE_WORDS), "truth")
        .otherwise("word")
    )
    seen = (
        text.select(F.stack(F.lit(len(fields)), *cells).alias("ordinal", "v"))
        .select("ordinal", forms.alias("form"))
        .groupBy("ordinal").agg(
            F.count(F.lit(1)).alias("row_count"), F.count(form).alias("non_null_count"),
            *[F.count_if(form == name).alias(name)
              for name in ("long", "decimal", "digits", "number", "truth")],
        )
    )
    listed = text.sparkSession.createDataFrame(
        [(i, f.name) for i, f in enumerate(fields)], "ordinal int, column string")
    zero = F.lit(0).cast("bigint")
    held, whole = F.col("non_null_count"), F.col("long") + F.col("decimal")
    found = (
        F.when(F.col("row_count") == 0, "string")
        .when(held == 0, "double")
        .when(F.col("long") == held, "bigint")
        .when(whole == held, "decimal(20,0)")
        .when(whole + F.col("digits") == held, "string")
        .when(whole + F.col("digits") + F.col("number") == held, "double")
        .when(F.col("truth") == held, "boolean")
        .otherwise("string")
    )
    return (
        listed.join(seen, "ordinal", "left")
        .withColumns({n: F.coalesce(n, zero) for n in ("row_count", "non_null_count")})
        .select("ordinal", "column", found.alias("inferred_type"), "row_count",
                "non_null_count")
    )


def typed_value(c: Column, inferred: str) -> Column:
    """A text value as the inferred type."""
    if inferred == "string":
        return c
    if inferred == "boolean":
        return F.when(c.isNotNull(), c.isin(*X.TRUE_WORDS))
    trimmed = F.trim(c)
    if inferred == "double":
        endless = F.when(trimmed.startswith("-"), float("-inf")).otherwise(float("inf"))
        return F.when(c.rlike(X.INFINITE_NUMBER), endless).otherwise(trimmed.try_cast("double"))
    return trimmed.cast(inferred)


def apply_types(text: DataFrame, types: dict[str, str]) -> DataFrame:
    return text.select(*[typed_value(P.col(n), t).alias(n) for n, t in types.items()])


def ingest_csv(
    spark: SparkSession, path: str, separator: str = ",", layout: Layout | None = None
) -> DataFrame:
    """Read, check, and type a delimited file or folder of files with one header."""
    try:
        text = read_text(spark, path, layout, separator)
    except AnalysisException as missing:
        raise AssayError("dataset_not_found", f"There is nothing at {path}.") from missing
    if malformed_rows(text, separator).head() is not None:
        raise AssayError("malformed_csv", "Some row has more fields than the header.")
    values = normalise_missing(text)
    types = {
        r["column"]: r["inferred_type"]
        for r in sorted(infer_types(values).collect(), key=lambda r: r["ordinal"])
    }
    return apply_types(values, types)
