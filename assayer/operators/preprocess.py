"""Imputation, scaling and one-hot encoding, learned from training rows only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame, Window, functions as F

from assayer.functions import predicates as P
from assayer.operators.features import (
    CATEGORICAL_TRANSFORM, NUMERIC_TRANSFORM, FeatureSelection,
)
from assayer.operators.frequencies import top_values
from assayer.operators.quantiles import quantiles
from assayer.session import scratch_path

FEATURES = "features"


@dataclass(frozen=True)
class NumericFit:
    """One learned triple per numeric feature; a few numbers per column."""

    medians: dict[str, float]
    means: dict[str, float]
    scales: dict[str, float]

    def transform(self, df: DataFrame, prefix: str = "") -> DataFrame:
        """Scaled features under ``prefix`` + name; infinities count as missing."""
        return df.withColumns({
            prefix + name: (
                F.coalesce(P.finite(df.schema[name]), F.lit(self.medians[name]))
                - F.lit(self.means[name])
            ) / F.lit(self.scales[name])
            for name in self.medians
        })


def fit_numeric(train: DataFrame, names: list[str]) -> NumericFit:
    """Exact medians, then mean and population deviation of the imputed values.

    A feature without any finite value is dropped; one without spread is not scaled.
    """
    if not names:
        return NumericFit({}, {}, {})
    medians = {
        r["column"]: r["quantiles"][0]
        for r in quantiles(train, names, (0.5,)).collect() if r["quantiles"]
    }
    kept = [n for n in names if n in medians]
    if not kept:
        return NumericFit({}, {}, {})
    filled = {
        n: F.coalesce(P.finite(train.schema[n]), F.lit(medians[n])) for n in kept
    }
    row = train.agg(*[
        m for k, n in enumerate(kept)
        for m in (F.avg(filled[n]).alias(f"m{k}"), F.stddev_pop(filled[n]).alias(f"s{k}"),
                  (F.min(filled[n]) == F.max(filled[n])).alias(f"c{k}"))
    ]).first()
    return NumericFit(
        {n: medians[n] for n in kept},
        {n: row[f"m{k}"] for k, n in enumerate(kept)},
        {n: 1.0 if row[f"c{k}"] or not row[f"s{k}"] else row[f"s{k}"]
         for k, n in enumerate(kept)},
    )


@dataclass(frozen=True)
class CategoricalFit:
    modes: dict[str, str]

    def transform(self, df: DataFrame, prefix: str = "") -> DataFrame:
        """Categories as text with gaps filled, under ``prefix`` + name."""
        return df.withColumns({
            prefix + name: F.coalesce(P.col(name).cast("string"), F.lit(mode))
            for name, mode in self.modes.items()
        })


def fit_categorical(train: DataFrame, names: list[str]) -> CategoricalFit:
    """Most frequent value per column, ties to the smallest."""
    if not names:
        return CategoricalFit({})
    return CategoricalFit({
        r["column"]: r["value"] for r in top_values(train, names, limit=1).collect()
    })


@dataclass(frozen=True)
class OneHot:
    """Numbered categories of some columns, as a stored table (place, value, slot).

    Only the number of categories of each column is known to the driver.
    """

    columns: list[str]
    vocabulary: DataFrame | None
    sizes: list[int]

    def indexed(self, df: DataFrame, suffix: str = "_index") -> DataFrame:
        """``df`` with the slot of each category; NULL where it was never seen.

        One join for each column, with a vocabulary that Spark broadcasts only if it is small.
        """
        for k, name in enumerate(self.columns):
            known = self.vocabulary.where(F.col("place") == k).select(
                F.col("value").alias("_value"), F.col("slot").alias(name + suffix))
            df = df.join(known, P.col(name).cast("string") == F.col("_value"), "left").drop(
                "_value")
        return df

    def transform(self, df: DataFrame, suffix: str = "_hot") -> DataFrame:
        """``df`` with a sparse vector for each column; an unseen category sets no slot."""
        if not self.columns:
            return df
        index = [f"{c}_index" for c in self.columns]
        df = self.indexed(df)
        # Unseen categories get the number after the last one, which the encoder drops.
        df = df.withColumns({
            i: F.coalesce(F.col(i), F.lit(max(n, 1))).cast("double")
            for i, n in zip(index, self.sizes, strict=True)})
        last = df.sparkSession.createDataFrame(
            [tuple(max(n - 1.0, 0.0) for n in self.sizes)],
            ", ".join(f"`{i}` double" for i in index))
        encoder = OneHotEncoder(
            inputCols=index, outputCols=[c + suffix for c in self.columns],
            handleInvalid="keep", dropLast=True)
        return encoder.fit(last).transform(df).drop(*index)


def fit_one_hot(train: DataFrame, columns: list[str]) -> OneHot:
    """Categories of each column numbered in text order, for any number of them.

    Distinct values are dealt into ranges of (column, text); a value's slot is the number of
    values in the ranges before its own, from prefix sums, and its place in its range.
    """
    if not columns:
        return OneHot([], None, [])
    cells = F.array(*[F.struct(F.lit(k).alias("place"), P.col(c).cast("string").alias("value"))
                      for k, c in enumerate(columns)])
    values = train.select(F.inline(cells)).where(F.col("value").isNotNull()).distinct()
    ranges = _written(values.repartitionByRange("place", "value").withColumn(
        "part", F.spark_partition_id()), "categories")
    counts = ranges.groupBy("place", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("place").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    base = counts.select("place", "part", F.coalesce(F.sum("n").over(before), F.lit(0))
                         .alias("base"))
    inner = Window.partitionBy("place", "part").orderBy("value")
    slots = ranges.withColumn("slot", F.row_number().over(inner) - 1).join(
        base, ["place", "part"]).select(
        "place", "value", (F.col("slot") + F.col("base")).alias("slot"))
    sizes = {r["place"]: r["n"] for r in counts.groupBy("place").agg(
        F.sum("n").alias("n")).collect()}
    return OneHot(list(columns), _written(slots, "vocabulary"),
                  [sizes.get(k, 0) for k in range(len(columns))])


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Preprocessor:
    numeric: NumericFit
    categorical: CategoricalFit
    encoder: OneHot

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with a sparse ``features`` vector."""
        assembler = VectorAssembler(
            inputCols=[f"n_{n}" for n in self.numeric.medians]
            + [f"{w}_hot" for w in self.encoder.columns],
            outputCol=FEATURES, handleInvalid="error")
        return assembler.transform(self.encoder.transform(
            _prepared(df, self.numeric, self.categorical)))

    def summary(self, df: DataFrame) -> DataFrame:
        """(column, role, transform, fill, mean, scale, slots) of each feature."""
        n, c = self.numeric, self.categorical
        rows = [(k, "numeric", NUMERIC_TRANSFORM, str(n.medians[k]), n.means[k], n.scales[k], 1)
                for k in n.medians]
        rows += [(k, "categorical", CATEGORICAL_TRANSFORM, mode, None, None, size)
                 for (k, mode), size in zip(c.modes.items(), self.encoder.sizes, strict=True)]
        return df.sparkSession.createDataFrame(
            rows, "column string, role string, transform string, fill string, mean double, "
                  "scale double, slots bigint")


def _prepared(df, numeric, categorical) -> DataFrame:
    return categorical.transform(numeric.transform(df, "n_"), "c_")


def fit_preprocessor(train: DataFrame, selection: FeatureSelection) -> Preprocessor:
    """Learn all transforms from ``train``; nothing of the test rows is seen."""
    numeric = fit_numeric(train, selection.numeric)
    categorical = fit_categorical(train, selection.categorical)
    return Preprocessor(numeric, categorical, fit_one_hot(
        categorical.transform(train, "c_"), [f"c_{n}" for n in categorical.modes]))
