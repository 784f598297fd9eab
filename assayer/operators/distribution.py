"""Equal-width histograms of all numeric columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions import predicates as P

BIN_COUNT = 10


def _long(df: DataFrame) -> DataFrame:
    fields = [(i, f) for i, f in enumerate(df.schema.fields) if P.is_numeric(f.dataType)]
    cells = [c for i, f in fields for c in (F.lit(i), P.finite(f))]
    return df.select(F.stack(F.lit(len(fields)), *cells).alias("ordinal", "value")).where(
        F.col("value").isNotNull())


def _edge(bin_index: Column, bins: int) -> Column:
    step = (F.col("high") - F.col("low")) / F.lit(float(bins))
    return F.when(bin_index >= bins, F.col("high")).otherwise(
        F.col("low") + bin_index.cast("double") * step)


def histogram(df: DataFrame, bin_count: int = BIN_COUNT) -> DataFrame:
    """(ordinal, column, bin_index, bin_start, bin_end, count), empty bins included.

    The last bin is closed on the right; a constant column has exactly one bin. Counts
    are combined per partition, so the shuffle carries one row per column and bin.
    """
    spark = df.sparkSession
    fields = [(i, f) for i, f in enumerate(df.schema.fields) if P.is_numeric(f.dataType)]
    if not fields:
        return spark.createDataFrame(
            [], "ordinal int, column string, bin_index int, bin_start double, "
                "bin_end double, count bigint")
    long = _long(df)
    named = spark.createDataFrame(
        [(i, f.name) for i, f in fields], "ordinal int, column string")
    limits = named.join(
        long.groupBy("ordinal").agg(F.min("value").alias("low"), F.max("value").alias("high")),
        "ordinal")

    value, low, high = F.col("value"), F.col("low"), F.col("high")
    guess = F.least(
        F.floor((value - low) * (F.lit(float(bin_count)) / (high - low))),
        F.lit(bin_count - 1)).cast("int")
    # Rounding may put a value one bin off: compare it with the edges themselves.
    index = F.col("guess")
    settled = (
        F.when(value < _edge(index, bin_count), index - 1)
        .when((index < bin_count - 1) & (value >= _edge(index + 1, bin_count)), index + 1)
        .otherwise(index)
    )
    # ``limits`` holds one row per column: its size never depends on the rows.
    placed = long.join(F.broadcast(limits), "ordinal").withColumn(
        "guess", F.when(low < high, guess).otherwise(0))
    counts = placed.select(
        "ordinal", F.when(low < high, settled).otherwise(0).alias("bin_index")
    ).groupBy("ordinal", "bin_index").agg(F.count(F.lit(1)).alias("count"))

    bins = limits.withColumn(
        "bin_index",
        F.explode(F.when(low < high, F.sequence(F.lit(0), F.lit(bin_count - 1)))
                  .otherwise(F.array(F.lit(0)))))
    return bins.join(counts, ["ordinal", "bin_index"], "left").select(
        "ordinal", "column", "bin_index",
        _edge(F.col("bin_index"), bin_count).alias("bin_start"),
        F.when(low < high, _edge(F.col("bin_index") + 1, bin_count)).otherwise(high)
        .alias("bin_end"),
        F.coalesce("count", F.lit(0).cast("bigint")).alias("count"),
    )


def histogram_skipped(df: DataFrame) -> DataFrame:
    """(ordinal, column, reason): columns without a histogram."""
    spark = df.sparkSession
    known = [
        (i, f.name, "boolean" if P.is_boolean(f.dataType) else "non_numeric")
        for i, f in enumerate(df.schema.fields) if not P.is_numeric(f.dataType)
    ]
    skipped = spark.createDataFrame(known, "ordinal int, column string, reason string")
    fields = [(i, f) for i, f in enumerate(df.schema.fields) if P.is_numeric(f.dataType)]
    if not fields:
        return skipped
    counts = df.agg(*[F.count(P.finite(f)).alias(f"n{i}") for i, f in fields])
    empty = counts.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("column"),
                 F.lit("no_finite_values").alias("reason"), F.col(f"n{i}").alias("n"))
        for i, f in fields
    ]))).where(F.col("n") == 0).drop("n")
    return skipped.unionAll(empty)
