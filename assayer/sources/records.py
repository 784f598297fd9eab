"""Records of delimited text whose quoted fields may hold line breaks, read by many tasks.

A file is cut anywhere at line ends, into the blocks that Spark reads. Whether a block begins
inside a quoted field depends on all blocks before it, so

1. each task tells of its blocks how they end, once if they begin outside and once if they begin
   inside a quoted field: a function of two values;
2. the functions of a file's blocks, in order, tell how each block begins, and in which block a
   record began that reaches into it: one small row for each block;
3. each task cuts its blocks into records from their first true beginning on. What belongs to a
   record of an earlier block, and the unfinished end, become pieces that are put together by
   the block where the record began: at most two for each block.

A quote opens a field only at its beginning; after a closing quote, and inside of other fields,
it is a character like others, so a stray quote does not turn the rest of a file around.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


@lru_cache(maxsize=8)
def _quoted(separator: str) -> re.Pattern:
    """The rest of a quoted field, and what follows it up to the next separator."""
    s = re.escape(separator)
    return re.compile(f'[^"]*(?:""[^"]*)*"(?!")(?:(?!{s}).)*', re.S)


def inside_after(line: str, inside: bool, separator: str = ",") -> bool:
    """Whether a quoted field is open at the end of a line."""
    if '"' not in line:
        return inside
    quoted, at = _quoted(separator), 0
    while True:
        if inside or line.startswith('"', at):
            found = quoted.match(line, at if inside else at + 1)
            if not found:
                return True
            inside, at = False, found.end()
            if at == len(line):
                return False
        else:
            at = line.find(separator, at)
            if at < 0:
                return False
        at += len(separator)


def _blocks_ended(lines: DataFrame, encoding: str, separator: str) -> DataFrame:
    """How each block ends, from either beginning, and whether a record ends in it that began
    before it."""
    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, closed = None, (False, True), False

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([state[0]]),
                 pa.array([state[1]]), pa.array([closed])],
                ["file", "start", "from_outside", "from_inside", "closes"])

        for batch in batches:
            for value, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != key:
                    if key:
                        yield row()
                    key, state, closed = block, (False, True), False
                if b'"' in value:
                    line = value.decode(encoding)
                    state = tuple(inside_after(line, x, separator) for x in state)
                closed = closed or not state[1]
        if key:
            yield row()

    return lines.mapInArrow(
        ended, "file string, start long, from_outside boolean, from_inside boolean, "
               "closes boolean")


def _blocks_begun(ended: DataFrame) -> DataFrame:
    """Blocks that begin inside a quoted field, and the block where its record began."""
    def begun(table: pa.Table) -> pa.Table:
        inside, origin, found = False, None, []
        for r in table.sort_by("start").to_pylist():
            if inside:
                found.append((r["file"], r["start"], origin))
            if not inside or r["closes"]:
                origin = r["start"]
            inside = r["from_inside"] if inside else r["from_outside"]
        return pa.table({"file": pa.array([f[0] for f in found], pa.string()),
                         "start": pa.array([f[1] for f in found], pa.int64()),
                         "origin": pa.array([f[2] for f in found], pa.int64())})

    return ended.groupBy("file").applyInArrow(begun, "file string, start long, origin long")


def records(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8",
            separator: str = ",") -> DataFrame:
    """(record): every record of the files but the header of each; empty lines are none."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"))
    # One row for each block of a file that begins inside a field.
    given = spark.sparkContext.broadcast({
        (r.file, r.start): r.origin
        for r in _blocks_begun(_blocks_ended(lines, encoding, separator)).toLocalIterator()})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, inside, origin, header = None, [], False, None, False
        out: list[tuple] = []

        def done(whole: bool) -> None:
            """Ends the record at hand; one of an earlier block is a piece of it."""
            nonlocal held, origin, header
            text = "\n".join(held)
            if not (whole and origin is None):
                out.append((text, key[0], key[1] if origin is None else origin, key[1], header))
            elif text.strip() and not header:
                out.append((text.removesuffix("\r"), None, None, None, False))
            held, origin = [], None
            header = False

        def given_out() -> pa.RecordBatch:
            nonlocal out
            columns = list(zip(*out, strict=True))
            out = []
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                ["record", "file", "origin", "start", "header"])

        for batch in batches:
            for value, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != key:
                    if held:
                        done(False)
                    key = block
                    origin = given.value.get(tuple(block))
                    inside, header = origin is not None, block[1] == 0
                line = value.decode(encoding)
                if header and not held:
                    line = line.removeprefix("﻿")
                held.append(line)
                inside = inside_after(line, inside, separator)
                if not inside:
                    done(True)
            if out:
                yield given_out()
        if held:
            done(False)
        if out:
            yield given_out()

    parts = lines.mapInArrow(
        cut, "record string, file string, origin long, start long, header boolean")
    whole = parts.where(F.col("file").isNull()).select("record")
    pieces = parts.where(F.col("file").isNotNull()).groupBy("file", "origin").agg(
        F.array_sort(F.collect_list(F.struct("start", "record"))).alias("pieces"),
        F.max("header").alias("header"))
    joined = pieces.where(~F.col("header")).select(F.regexp_replace(
        F.array_join(F.transform("pieces", lambda p: p["record"]), "\n"), "\r$", "")
        .alias("record"))
    return whole.unionByName(joined)
