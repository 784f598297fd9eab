"""Pairwise-complete Pearson correlation of all numeric column pairs in one pass."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.functions import predicates as P

MINIMUM_OBSERVATIONS = 3
TOP_PAIRS = 10
# Where centring by the column's middle costs more than so large a share of the squares, a
# pair is centred by its own means.
OWN_CENTRE_SHARE = 1e-6
# Columns in a block, pairs that a task holds, and partitions that are merged at a time.
TILE = 32
HELD_PAIRS = 512 * 1024
BRANCH = 256

PAIRS = (
    "a int, b int, column_a string, column_b string, coefficient double, "
    "observations bigint"
)


def correlation(
    df: DataFrame, minimum_observations: int = MINIMUM_OBSERVATIONS
) -> DataFrame:
    """(a, b, column_a, column_b, coefficient, observations), a before b in the table.

    Pairs with too few common rows, no variation or infinite values are left out.

    Every pair has rows of its own, and so means of its own. Pairs are cut into tiles of two
    blocks of columns. Each batch gives a tile its numbers, means and centred sums of squares and
    products; these are merged by the update formula for two samples, within a partition and
    then in a tree over partitions, in their order, so that no result depends on which task ends
    first. A task holds at most ``HELD_PAIRS`` pairs: more of them take more passes, each over the
    columns of its own tiles.
    """
    fields = P.numeric_fields(df.schema)
    if len(fields) < 2:
        return df.sparkSession.createDataFrame([], PAIRS)
    named = F.array(*[F.lit(f.name) for f in fields])
    return (
        _moments(df, fields)
        .select("a", "b", _coefficient().alias("coefficient"),
                F.col("n").cast("bigint").alias("observations"))
        .where((F.col("observations") >= minimum_observations)
               & F.col("coefficient").isNotNull())
        .select(
            "a", "b", named[F.col("a")].alias("column_a"), named[F.col("b")].alias("column_b"),
            F.round("coefficient", 6).alias("coefficient"), "observations",
        )
    )


def _coefficient() -> Column:
    """Pearson's coefficient from the centred sums of one pair; NULL where undefined."""
    quotient = F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy"))
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), quotient))
    return F.when((F.col("endless") == 0) & (F.col("xx") > 0) & (F.col("yy") > 0)
                  & ~F.isnan(quotient), bounded)


NAMES = ("n", "x", "y", "xx", "yy", "xy", "endless")


def _centred(values: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean and distances from it; equal values have none."""
    if values.min() == values.max():
        return values[0], np.zeros(len(values))
    mean = values.mean()
    return mean, values - mean


def _middle(values: np.ndarray, fine: np.ndarray) -> float:
    """The middle of some hundred values. It is only where sums begin: all values enter them."""
    at = np.flatnonzero(fine)
    return float(np.median(values[at[::max(len(at) // 100, 1)]])) if len(at) else 0.0


class _Batch:
    """One batch, a column in each row, moved to their middles, for any pairs of columns."""

    def __init__(self, values: np.ndarray) -> None:
        held, endless = ~np.isnan(values), np.isinf(values)
        self.values, self.fine = values, held & ~endless
        self.middle = np.array([_middle(c, f) for c, f in zip(values, self.fine, strict=True)])
        middle = self.middle[:, None]
        self.moved = np.where(self.fine, values, middle) - middle
        self.squares = self.moved * self.moved
        self.here = self.fine.astype("float64")
        self.far = endless.astype("float64") if endless.any() else None
        self.known = held.astype("float64") if self.far is not None else None

    def moments(self, rows: slice, columns: slice, first: np.ndarray,
                second: np.ndarray) -> np.ndarray:
        """``NAMES`` of the pairs of two blocks, given by their places in the blocks."""
        height = rows.stop - rows.start
        left = np.concatenate([self.here[rows], self.moved[rows]])
        if rows == columns:
            right, width = left, height
        else:
            right = np.concatenate([self.here[columns], self.moved[columns]])
            width = columns.stop - columns.start
        products = left @ right.T
        n, sum_b = products[:height, :width], products[:height, width:]
        sum_a, both = products[height:, :width], products[height:, width:]
        with np.errstate(all="ignore"):
            shift_a, shift_b = np.where(n > 0, sum_a / n, 0.0), np.where(n > 0, sum_b / n, 0.0)
        raw_a = self.squares[rows] @ self.here[columns].T
        raw_b = raw_a.T if rows == columns else self.here[rows] @ self.squares[columns].T
        square_a, square_b = raw_a - n * shift_a * shift_a, raw_b - n * shift_b * shift_b
        endless = np.zeros(n.shape) if self.far is None else (
            self.far[rows] @ self.known[columns].T + self.known[rows] @ self.far[columns].T)
        out = np.stack([
            n, self.middle[rows][:, None] + shift_a, self.middle[columns][None, :] + shift_b,
            square_a, square_b, both - n * shift_a * shift_b, endless])[:, first, second]
        lossy = (square_a <= OWN_CENTRE_SHARE * raw_a) | (square_b <= OWN_CENTRE_SHARE * raw_b)
        for k in np.flatnonzero((out[0] > 0) & lossy[first, second]):
            x, y = first[k] + rows.start, second[k] + columns.start
            common = self.fine[x] & self.fine[y]
            x_mean, x = _centred(self.values[x, common])
            y_mean, y = _centred(self.values[y, common])
            out[1:6, k] = x_mean, y_mean, x @ x, y @ y, x @ y
        return out


def _merged(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Moments of two samples together."""
    n = one[0] + two[0]
    with np.errstate(all="ignore"):
        share = np.where(n > 0, two[0] / n, 0.0)
    dx, dy = two[1] - one[1], two[2] - one[2]
    weight = one[0] * share
    return np.stack([
        n, np.where(one[0] > 0, one[1] + dx * share, two[1]),
        np.where(one[0] > 0, one[2] + dy * share, two[2]),
        one[3] + two[3] + dx * dx * weight, one[4] + two[4] + dy * dy * weight,
        one[5] + two[5] + dx * dy * weight, one[6] + two[6]])


def _tiles(width: int) -> list[tuple[slice, slice]]:
    """Pairs of blocks of columns, a block with itself among them."""
    blocks = [slice(k, min(k + TILE, width)) for k in range(0, width, TILE)]
    return [(a, b) for k, a in enumerate(blocks) for b in blocks[k:]
            if a is not b or a.stop - a.start > 1]


def _inside(rows: slice, columns: slice) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a tile, the column that comes first in the table first."""
    height, width = rows.stop - rows.start, columns.stop - columns.start
    if rows == columns:
        return np.triu_indices(height, 1)
    return tuple(np.indices((height, width)).reshape(2, -1))


def _moments(df: DataFrame, fields) -> DataFrame:
    """Moments of all pairs, in as many passes as their number needs."""
    tiles = _tiles(len(fields))
    some = max(HELD_PAIRS // (TILE * TILE), 1)
    return reduce(DataFrame.unionAll, (
        _pass(df, fields, tiles[k:k + some]) for k in range(0, len(tiles), some)))


def _pass(df: DataFrame, fields, tiles: list[tuple[slice, slice]]) -> DataFrame:
    used = sorted({k for tile in tiles for side in tile for k in range(side.start, side.stop)})
    place = {k: i for i, k in enumerate(used)}
    local = [tuple(slice(place[s.start], place[s.start] + s.stop - s.start) for s in tile)
             for tile in tiles]
    inside = [_inside(*tile) for tile in tiles]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(NAMES), len(first))) for first, _ in inside]
        for batch in batches:
            if batch.num_rows:
                prepared = _Batch(np.stack(
                    [c.to_numpy(zero_copy_only=False) for c in batch.columns]))
                totals = [_merged(total, prepared.moments(*tile, *pairs)) for total, tile, pairs
                          in zip(totals, local, inside, strict=True)]
        number = TaskContext.get().partitionId()
        count = len(tiles)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(count, dtype="int32")),
            pa.array(np.full(count, number // BRANCH, "int32")),
            pa.array(np.full(count, number, "int32")),
            pa.array([t.tobytes() for t in totals], pa.binary())],
            ["tile", "branch", "place", "moments"])

    def merged(parts: pd.DataFrame) -> np.ndarray:
        total = np.zeros((len(NAMES), len(inside[parts["tile"].iloc[0]][0])))
        for data in parts.sort_values("place")["moments"]:
            total = _merged(total, np.frombuffer(data).reshape(total.shape))
        return total

    def branch(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            "tile": parts["tile"].iloc[:1], "branch": np.int32(0),
            "place": parts["branch"].iloc[:1], "moments": [merged(parts).tobytes()]})

    def root(parts: pd.DataFrame) -> pd.DataFrame:
        tile = parts["tile"].iloc[0]
        (rows, columns), (first, second) = tiles[tile], inside[tile]
        return pd.DataFrame({
            "a": (first + rows.start).astype("int32"),
            "b": (second + columns.start).astype("int32"), **dict(zip(NAMES, merged(parts)))})

    schema = "tile int, branch int, place int, moments binary"
    # NaN stays here, since it counts as missing there.
    parts = df.select(*[P.col(fields[k].name).cast("double").alias(f"v{k}") for k in used]) \
        .mapInArrow(partial, schema)
    return parts.groupBy("tile", "branch").applyInPandas(branch, schema) \
        .groupBy("tile").applyInPandas(
            root, "a int, b int, " + ", ".join(f"{n} double" for n in NAMES)) \
        .where("n > 0 OR endless > 0")


def correlation_status(
    df: DataFrame, pairs: DataFrame, minimum_observations: int = MINIMUM_OBSERVATIONS
) -> DataFrame:
    """One row: whether any coefficient exists and, if not, why."""
    eligible = len(P.numeric_fields(df.schema))
    few = F.lit(eligible < 2)
    found = F.col("pair_count")
    return pairs.agg(F.count(F.lit(1)).alias("pair_count")).select(
        F.lit("pearson").alias("method"),
        F.lit(minimum_observations).alias("minimum_observations"),
        F.lit(eligible).alias("eligible_count"),
        "pair_count",
        F.when(few | (found == 0), "insufficient_data").otherwise("computed").alias("status"),
        F.when(few, F.lit(f"Correlation needs two numeric columns; there are {eligible}."))
        .when(found == 0, F.lit(
            f"No two numeric columns share {minimum_observations} filled rows with a "
            "defined coefficient."))
        .alias("message"),
    )


def strength(coefficient: Column) -> Column:
    """Fixed cut-offs on the absolute value; zero counts as positive."""
    size = F.abs(coefficient)
    word = (
        F.when(size >= 0.7, "strong").when(size >= 0.4, "moderate")
        .when(size >= 0.2, "weak").otherwise("very weak or negligible")
    )
    return F.concat_ws(" ", word, F.when(coefficient >= 0, "positive").otherwise("negative"))


def strongest_pairs(
    pairs: DataFrame, limit: int = TOP_PAIRS, by: Iterable[str] = ()
) -> DataFrame:
    """Pairs by falling absolute coefficient, ties in table order, with a ``rank``."""
    order = Window.partitionBy(*by).orderBy(
        F.abs("coefficient").desc(), F.col("a"), F.col("b"))
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
