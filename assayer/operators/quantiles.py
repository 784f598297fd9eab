"""Exact, linearly interpolated quantiles whose memory does not grow with the data.

Equal values of a column are combined, and the combined values of all columns are dealt into
ranges by (column, value). The count of each range is small, so their prefix sums tell in
which range every wanted rank lies. A second pass reads the values of those ranges only, as
many as one task was dealt, and takes the values at the ranks. The same for every size;
nothing is approximate.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from assayer.functions import predicates as P
from assayer.operators.frequencies import picked

QUARTILES = (0.25, 0.5, 0.75)


@dataclass(frozen=True)
class _Range:
    """The values of a column from ``low`` to ``high``; ``below`` lie before them."""

    ordinal: int
    field: T.StructField
    low: float
    high: float
    below: int
    count: int

    def values(self) -> Column:
        value = P.finite(self.field)
        return F.when((value >= F.lit(self.low)) & (value <= F.lit(self.high)), value)


def quantiles(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    probabilities: tuple[float, ...] = QUARTILES,
) -> DataFrame:
    """(ordinal, column, quantiles) over the finite values of numeric columns."""
    spark = df.sparkSession
    fields = [(i, f) for i, f in picked(df, columns) if P.is_numeric(f.dataType)]
    if not fields:
        return spark.createDataFrame([], "ordinal int, column string, quantiles array<double>")
    listed = spark.createDataFrame(
        [(i, f.name) for i, f in fields], "ordinal int, column string")
    wanted = _wanted(_ranges(df, fields), probabilities)
    if not wanted:
        return listed.withColumn("quantiles", F.lit(None).cast("array<double>"))
    by_column = _read(df, wanted).groupBy("ordinal").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))),
                    lambda x: x["value"]).alias("quantiles"))
    return listed.join(F.broadcast(by_column), "ordinal", "left").select(
        "ordinal", "column", "quantiles")


def _combined(df, streams: list[tuple[int, Column]]) -> DataFrame:
    """(stream, value, count) of the values that are not NULL."""
    cells = [c for n, value in streams for c in (F.lit(n), value)]
    return (
        df.select(F.stack(F.lit(len(streams)), *cells).alias("stream", "value"))
        .where(F.col("value").isNotNull())
        .groupBy("stream", "value").agg(F.count(F.lit(1)).alias("count"))
    )


def _ranges(df, fields) -> dict[int, list[_Range]]:
    """The ranges of each column in order.

    One row per range and column in it comes to the driver: fewer than there are partitions
    and columns together. Later passes use the ends of a range, not its partition, so they
    may be dealt anew.
    """
    counts = _combined(df, [(i, P.finite(f)) for i, f in fields])
    rows = counts.repartitionByRange("stream", "value").groupBy(
        F.spark_partition_id().alias("part"), "stream").agg(
        F.min("value").alias("low"), F.max("value").alias("high"),
        F.sum("count").alias("count")).collect()
    named = dict(fields)
    found: dict[int, list[_Range]] = {}
    for r in sorted(rows, key=lambda r: (r["stream"], r["low"])):
        before = found.setdefault(r["stream"], [])
        below = before[-1].below + before[-1].count if before else 0
        before.append(_Range(r["stream"], named[r["stream"]], r["low"], r["high"], below,
                             r["count"]))
    return found


def _wanted(ranges: dict[int, list[_Range]], probabilities) -> list[tuple]:
    """(range, place, second, rank in the range, fraction), two for each quantile."""
    wanted = []
    for held in ranges.values():
        n = held[-1].below + held[-1].count
        for place, probability in enumerate(probabilities):
            at = probability * (n - 1)
            for second, rank in ((False, math.floor(at)), (True, math.ceil(at))):
                inside = next(r for r in held if rank < r.below + r.count)
                wanted.append((inside, place, second, rank - inside.below,
                               at - math.floor(at)))
    return wanted


def _read(df, wanted: list[tuple]) -> DataFrame:
    """(ordinal, place, value) from the values of the ranges that hold a wanted rank."""
    streams = list(dict.fromkeys(w[0] for w in wanted))
    number = {r: n for n, r in enumerate(streams)}
    asked = df.sparkSession.createDataFrame(
        [(number[r], r.ordinal, place, second, at, fraction)
         for r, place, second, at, fraction in wanted],
        "stream int, ordinal int, place int, second boolean, at bigint, fraction double")
    counts = _combined(df, [(n, r.values()) for n, r in enumerate(streams)])
    # A stream is one range: what one task was dealt.
    upto = F.sum("count").over(
        Window.partitionBy("stream").orderBy("value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # Two rows per wanted quantile: the broadcast side is as small as the question.
    hits = counts.withColumn("upto", upto).join(
        F.broadcast(asked), "stream").where(
        (F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("count")))
    v0 = F.max(F.when(~F.col("second"), F.col("value")))
    v1 = F.max(F.when(F.col("second"), F.col("value")))
    return hits.groupBy("ordinal", "place", "fraction").agg(
        v0.alias("v0"), v1.alias("v1")).select(
        "ordinal", "place",
        (F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("fraction")).alias("value"))
