"""Checks on files before they are parsed, for many files at once."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayer.errors import AssayError
from assayer.session import scratch_path

# Fixed limits.
ALLOWED_SUFFIX = ".csv"
LARGEST_FILE_BYTES = 50 * 1024 * 1024
SAMPLE_CHARACTERS = 4096
LARGEST_UNPRINTABLE_SHARE = 0.30
# Letters, digits, punctuation and white space of ASCII.
UNPRINTABLE = r"[^\x20-\x7E\t\n\r\x0B\x0C]"


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, length) of files below a folder, empty ones among them.

    Folders are opened level by level, each by the task that has its row, and what a level holds
    is stored before the next one is read; no path comes to the driver. Names that begin with a
    dot or an underscore are left out, as Spark's own readers do. A folder that cannot be read is
    an error (``unreadable_folder``).
    """
    root = path if "://" in path or path.startswith("file:") else f"file://{path}"
    level = spark.createDataFrame([(root,)], "path string")
    found = []
    while True:
        seen = _stored(level.repartition("path").mapInArrow(_opened, LISTED), "listing")
        broken = seen.where(F.col("error").isNotNull()).first()
        if broken:
            raise AssayError("unreadable_folder", f"{broken.path}: {broken.error}")
        found.append(seen.where("NOT is_folder"))
        level = seen.where("is_folder").select("path")
        if level.isEmpty():
            break
    files = reduce(DataFrame.unionAll, found)
    # The pattern's wildcards as a regular expression.
    return files.where(F.col("name").rlike(f"^(?:{fnmatch.translate(pattern)})$")).select(
        "path", "name", "length")


LISTED = "path string, name string, length long, is_folder boolean, error string"


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands directly in each folder."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
    names = [c.split()[0] for c in LISTED.split(", ")]
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            rows = []
            try:
                system, inner = fs.FileSystem.from_uri(_quoted(folder))
                infos = system.get_file_info(inner)
                infos = [infos] if infos.is_file else system.get_file_info(fs.FileSelector(inner))
                head = folder.rstrip("/")
                for info in infos:
                    name = info.base_name
                    if not name.startswith((".", "_")):
                        whole = head if info.path == inner else f"{head}/{name}"
                        rows.append((whole, name, info.size or 0,
                                     info.type == fs.FileType.Directory, None))
            except OSError as error:
                rows = [(folder, None, 0, False, str(error))]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names)


def _quoted(path: str) -> str:
    """A path as address: names may hold signs that mean something there."""
    scheme, _, rest = path.partition("://")
    return f"{scheme}://{quote(rest, safe='/:@')}"


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_verdict(max_bytes: int = LARGEST_FILE_BYTES) -> Column:
    """The first failing check of a (name, length) row, or NULL."""
    name = F.trim("name")
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "missing_filename")
        .when(~F.lower("name").endswith(ALLOWED_SUFFIX), "unsupported_file_type")
        .when(F.col("length") == 0, "empty_file")
        .when(F.col("length") > max_bytes, "file_too_large")
    )


def file_screen(files: DataFrame, max_bytes: int = LARGEST_FILE_BYTES) -> DataFrame:
    return files.select("path", "name", "length", file_verdict(max_bytes).alias("verdict"))


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 without its mark, else Latin-1."""
    utf8 = F.regexp_replace(content.cast("string"), "^﻿", "")
    latin = F.decode(content, "ISO-8859-1")
    return F.when(F.is_valid_utf8(content.cast("string")), utf8).otherwise(latin)


def looks_binary(text: Column) -> Column:
    """A NUL, or too many unprintable characters, among the first ones."""
    sample = F.substring(text, 1, SAMPLE_CHARACTERS)
    odd = F.regexp_count(sample, F.lit(UNPRINTABLE))
    share = F.coalesce(F.try_divide(odd, F.length(sample)), F.lit(0.0))
    return F.contains(sample, F.lit("\u0000")) | (share > LARGEST_UNPRINTABLE_SHARE)


def content_verdict(content: Column) -> Column:
    """``unsupported_content`` for bytes that are no text, or NULL."""
    return F.when(looks_binary(decoded(content)), "unsupported_content")


def binary_screen(
    spark: SparkSession, path: str, pattern: str = "*", max_bytes: int = LARGEST_FILE_BYTES
) -> DataFrame:
    """(path, length, verdict) of every file: too large, no text, or NULL.

    The size filter reaches the source, which then skips larger files unread.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    read = files.where(F.col("length") <= max_bytes).select(
        "path", content_verdict(F.col("content")).alias("verdict"))
    return files.select("path", "length").join(read, "path", "left").select(
        "path", "length",
        F.when(F.col("length") > max_bytes, "file_too_large").otherwise(F.col("verdict"))
        .alias("verdict"))
