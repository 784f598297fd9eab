"""Correlation and histograms."""

import numpy as np
import pytest

from assayer.operators import correlation as C, distribution as D
from assayer.plans.inputs import source

INF = float("inf")
SMALL = "/root/testdata/sf0.001"


def test_pairwise_complete(spark, rows):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(200, 4)) * [1, 1e-6, 1e6, 5] + [0, 3, -1e9, 7]
    data[:, 3] += data[:, 0]
    gaps = rng.random((200, 4)) < 0.2
    table = [[None if g else float(v) for v, g in zip(r, h)] for r, h in zip(data, gaps)]
    df = spark.createDataFrame(table, "a double, b double, c double, d double").repartition(6)
    got = rows(C.correlation(df), "a", "b")
    assert len(got) == 6
    for (i, j), r in got.items():
        both = ~gaps[:, i] & ~gaps[:, j]
        assert r["observations"] == both.sum()
        assert r["coefficient"] == pytest.approx(
            np.corrcoef(data[both, i], data[both, j])[0, 1], abs=2e-6)


def test_tiles_passes_and_branches(spark, rows, monkeypatch):
    rng = np.random.default_rng(4)
    data = np.round(rng.normal(size=(300, 8)), 3)
    data[:, 5] = data[:, 1] * 2
    gaps = rng.random((300, 8)) < 0.1
    table = [[None if g else float(v) for v, g in zip(r, h)] for r, h in zip(data, gaps)]
    df = spark.createDataFrame(table, ", ".join(f"c{k} double" for k in range(8))).repartition(7)
    whole = rows(C.correlation(df), "a", "b")
    monkeypatch.setattr(C, "TILE", 3)
    monkeypatch.setattr(C, "BRANCH", 2)
    for held in (9, 27, 1000):
        monkeypatch.setattr(C, "HELD_PAIRS", held)
        got = rows(C.correlation(df), "a", "b")
        assert got == whole and len(got) == 28
    for (i, j), r in whole.items():
        both = ~gaps[:, i] & ~gaps[:, j]
        assert r["coefficient"] == pytest.approx(
            np.corrcoef(data[both, i], data[both, j])[0, 1], abs=2e-6)


def test_complete_table(spark, rows):
    df = spark.createDataFrame([(i, 2.0 * i, -i, 1.5) for i in range(9)],
                               "a int, b double, c bigint, flat double")
    got = rows(C.correlation(df), "column_a", "column_b")
    assert {k: v["coefficient"] for k, v in got.items()} == {
        ("a", "b"): 1.0, ("a", "c"): -1.0, ("b", "c"): -1.0}


def test_skipped_pairs(spark):
    df = spark.createDataFrame(
        [(1.0, None, 1.0, INF, True), (2.0, None, 1.0, 1.0, False), (3.0, 1.0, 1.0, 2.0, True),
         (None, 2.0, 1.0, 3.0, True)], "a double, b double, flat double, endless double, t boolean")
    pairs = C.correlation(df)
    assert pairs.count() == 0
    status = C.correlation_status(df, pairs).first()
    assert status["status"] == "insufficient_data" and status["eligible_count"] == 4


def test_flat_within_the_shared_rows(spark):
    df = spark.createDataFrame(
        [(0.1, float(i)) if i < 5 else (0.7, None) for i in range(9)], "x double, y double")
    assert C.correlation(df).count() == 0


@pytest.mark.parametrize("outlier", [1e7, 1e9])
def test_gap_beside_an_outlier(spark, outlier):
    """Rows that a pair does not share have no say in it, however large their values."""
    data = [(1 + i * 1e-9, float(i)) for i in range(10)] + [(None, outlier)]
    for parts in (1, 4):
        pairs = C.correlation(spark.createDataFrame(data, "b double, c double")
                              .repartition(parts)).first()
        assert (pairs["coefficient"], pairs["observations"]) == (1.0, 10)


def test_two_distant_clusters(spark, rows):
    """Half of the rows lie far from the middle of the column, where the pair has its rows."""
    rng = np.random.default_rng(5)
    x = np.where(np.arange(400) % 2, 1e9, 0.0) + rng.normal(size=400)
    y = x % 1000 + rng.normal(size=400)
    y[np.arange(400) % 2 == 0] = np.nan
    df = spark.createDataFrame([(float(a), None if np.isnan(b) else float(b))
                                for a, b in zip(x, y)], "x double, y double").repartition(3)
    both = ~np.isnan(y)
    assert C.correlation(df).first()["coefficient"] == pytest.approx(
        np.corrcoef(x[both] - 1e9, y[both])[0, 1], abs=2e-6)


def test_strength(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(c,) for c in (0.7, -0.4, 0.2, 0.0, -0.19)], "c double")
    assert [r[0] for r in df.select(C.strength(F.col("c"))).collect()] == [
        "strong positive", "moderate negative", "weak positive",
        "very weak or negligible positive", "very weak or negligible negative"]


def test_histogram_of_a_range(spark):
    df = spark.createDataFrame([(i,) for i in range(100)], "x int")
    got = D.histogram(df).orderBy("bin_index").collect()
    assert [r["count"] for r in got] == [10] * 10
    assert (got[0]["bin_start"], got[-1]["bin_end"]) == (0.0, 99.0)


def test_constant_column_has_one_bin(spark):
    got = D.histogram(spark.createDataFrame([(4.5,)] * 3 + [(INF,)], "x double")).collect()
    assert [(r["bin_start"], r["bin_end"], r["count"]) for r in got] == [(4.5, 4.5, 3)]


@pytest.mark.parametrize("bins", [3, 7, 10])
def test_bins_match_numpy(spark, bins):
    rng = np.random.default_rng(bins)
    values = np.concatenate([np.arange(0, 1.05, 0.1), rng.integers(0, 11, 400) / 10.0])
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(3)
    counts, edges = np.histogram(values, bins=bins, range=(values.min(), values.max()))
    got = D.histogram(df, bins).orderBy("bin_index").collect()
    assert [r["count"] for r in got] == counts.tolist()
    assert [r["bin_start"] for r in got] == pytest.approx(edges[:-1].tolist())


def test_skipped_columns(spark):
    df = spark.createDataFrame([(1, "a", True, None)], "n int, s string, b boolean, e double")
    got = {r["column"]: r["reason"] for r in D.histogram_skipped(df).collect()}
    assert got == {"s": "non_numeric", "b": "boolean", "e": "no_finite_values"}


def test_wide_inputs_are_not_one_long_method(spark):
    """The JVM never compiles a method above 8,000 bytes, as whole-stage code of 66 columns is."""
    source(spark, SMALL, "wide_lineitem")
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_moments_of_blocks():
    rng = np.random.default_rng(3)
    values = rng.normal(1e6, 3, (5, 400))
    values[1, ::3] = np.nan
    values[4, 7] = np.inf
    batch = C._Batch(values)
    for rows, columns in ((slice(0, 3), slice(0, 3)), (slice(0, 3), slice(3, 5))):
        first, second = C._inside(rows, columns)
        got = batch.moments(rows, columns, first, second)
        for k, (i, j) in enumerate(zip(first + rows.start, second + columns.start, strict=True)):
            both = np.isfinite(values[i]) & np.isfinite(values[j])
            x, y = values[i, both], values[j, both]
            assert got[0, k] == both.sum() and got[6, k] == np.isinf(values[j]).sum()
            assert got[1:, k][:5] == pytest.approx(
                [x.mean(), y.mean(), x.var() * len(x), y.var() * len(y),
                 ((x - x.mean()) * (y - y.mean())).sum()], rel=1e-6, abs=1e-4)
