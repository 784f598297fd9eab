import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.errors import AssayError
from assayer.functions import text as X
from assayer.operators import facts as A, frequencies as V, profile as R, quantiles as L
from assayer.plans.table import TableProfile

INF, NAN = float("inf"), float("nan")


def test_known_statistics(spark, rows):
    df = spark.createDataFrame([(i,) for i in range(1, 11)], "x int")
    got = rows(R.numeric_profile(df), "column")["x"]
    assert (got["min"], got["max"], got["mean"], got["median"]) == (1.0, 10.0, 5.5, 5.5)
    assert (got["q1"], got["q3"], got["iqr"]) == (3.25, 7.75, 4.5)
    assert got["std"] == pytest.approx(3.0276503540974917)


def test_infinities_and_nan(spark, rows):
    df = spark.createDataFrame([(1.0,), (0.0,), (-3.0,), (INF,), (-INF,), (NAN,), (None,)],
                               "x double")
    got = rows(R.numeric_profile(df), "column")["x"]
    assert (got["min"], got["max"], got["null_count"]) == (-3.0, 1.0, 2)
    assert (got["zero_count"], got["negative_count"], got["infinite_count"]) == (1, 2, 2)


def test_wide_tables_go_in_blocks(spark, rows):
    """Wide tables give what their columns give alone, and no stack is as wide as they are."""
    cells = [(1.5, 7), (None, None), (NAN, 3), (INF, 0), (-0.0, -4), (0.0, -4), (0.0, -4),
             (1.5, None)]
    data = [tuple(v for _ in range(20) for v in pair) + (word,)
            for pair, word in zip(cells, ["a", None, "a", "b", "c", "c", "d", "a"], strict=True)]
    names = [f"{kind}{k}" for k in range(20) for kind in "di"]
    df = spark.createDataFrame(data, ", ".join(
        f"{n} {'double' if n[0] == 'd' else 'bigint'}" for n in names) + ", word string")
    stats = A.column_stats(df)
    assert stats._jdf.queryExecution().optimizedPlan().toString().count("Generate stack") >= 3
    alone = rows(A.column_stats(df, ["d0", "i0", "word"]), "ordinal")
    # By place: both columns come twenty times.
    same = {i: 40 if i == 40 else i % 2 for i in range(41)}
    for wide, narrow in (
            (rows(stats, "ordinal"), alone),
            (rows(V.frequency_summary(df), "ordinal"),
             rows(V.frequency_summary(df, ["d0", "i0", "word"]), "ordinal")),
            (rows(A.column_examples(df), "ordinal"),
             rows(A.column_examples(df.select("d0", "i0", "word")), "ordinal"))):
        assert sorted(wide) == list(range(41))
        for i, got in wide.items():
            want = narrow.get(same[i], narrow.get(2))
            assert {k: v for k, v in got.items() if k not in ("ordinal", "column")} == {
                k: v for k, v in want.items() if k not in ("ordinal", "column")}
    # -0.0 equals 0.0, NaN is missing, and a gap is no zero.
    got = V.duplicate_rows(df).first()
    assert tuple(got) == (8, 1)
    assert tuple(V.duplicate_rows(df.drop("word")).first()) == (8, 2)
    moved = spark.createDataFrame([(None, 0.0), (0.0, None), (0.0, 0.0), (NAN, 0.0)],
                                  "a double, b double")
    wide = moved.select("a", "b", *[F.lit(1).alias(f"x{k}") for k in range(40)])
    assert tuple(V.duplicate_rows(wide).first()) == (4, 1)


def test_nothing_finite(spark, rows):
    df = spark.createDataFrame([(INF,), (None,)], "x double")
    got = rows(R.numeric_profile(df), "column")["x"]
    assert got["min"] is None and got["median"] is None and got["std"] is None
    one = rows(R.numeric_profile(spark.createDataFrame([(4.0,)], "x double")), "column")["x"]
    assert one["std"] is None and one["median"] == 4.0


def test_empty_table_keeps_its_columns(spark, rows):
    df = spark.createDataFrame([], "a string, b double, c timestamp, d boolean")
    got = rows(A.column_facts(df), "column")
    assert {c: r["semantic_type"] for c, r in got.items()} == {
        "a": "categorical", "b": "numeric", "c": "datetime", "d": "boolean"}
    assert all(r["row_count"] == 0 and r["null_percentage"] == 0.0 for r in got.values())
    assert rows(R.dataset_profile(df, "e", A.column_facts(df)), "dataset_id")["e"][
        "missing_percentage"] == 0.0


def test_semantic_types(spark, rows):
    n = 30
    df = spark.createDataFrame([(
        f"2024-01-{i % 28 + 1:02d}", str(i), f"sentence number {i}", "ab"[i % 2], i % 2 == 0,
        [i], f"2024-01-{i % 9 + 1:02d}" if i % 10 else "junk", f"code{i % 10}")
        for i in range(n)],
        "day string, digits string, words string, letter string, flag boolean, "
        "nested array<int>, nine string, few string")
    got = {c: r["semantic_type"] for c, r in rows(A.column_facts(df), "column").items()}
    assert got == {
        "day": "datetime", "digits": "text", "words": "text", "letter": "categorical",
        "flag": "boolean", "nested": "unknown", "nine": "datetime", "few": "categorical"}
    nine = rows(A.column_facts(df), "column")["nine"]
    assert nine["unparseable_count"] == 3 and nine["unique_count"] == 10


def test_date_layouts(spark):
    texts = {
        "2024-03-01": "2024-03-01 00:00:00", "2024-3-1 7:05": "2024-03-01 07:05:00",
        "2024-03-01T07:05:09.250": "2024-03-01 07:05:09.25",
        "2024-03-01T07:05:09+02:00": "2024-03-01 05:05:09", "2024/03/01": "2024-03-01 00:00:00",
        "03/01/2024": "2024-03-01 00:00:00", "25/12/2024": "2024-12-25 00:00:00",
        "Mar 1, 2024": "2024-03-01 00:00:00", "March 1, 2024": "2024-03-01 00:00:00",
        "1 Mar 2024": "2024-03-01 00:00:00", "2024": None, "2024-13-45": None, "12 apples": None,
        "": None, "x" * 50: None, "5.1.2024 10:30": "2024-05-01 10:30:00",
        "1/5/2024 10:30 PM": "2024-01-05 22:30:00", "Jan 5, 2024 10:30": "2024-01-05 10:30:00",
        "2024-01-05 10:30:00.123 PM": "2024-01-05 22:30:00.123", "Jan 5 24": None,
        "20240105T101010Z": "2024-01-05 10:10:10", "20240105T101010": "2024-01-05 10:10:10",
        "13.1.2024 1:02:03": "2024-01-13 01:02:03", "Mon, Jan 5, 2024": "2024-01-05 00:00:00",
        "  5 September 2024 9:05 ": "2024-09-05 09:05:00", "Foo 5, 2024": None,
        "2024-01-05T10:30:00+0530": "2024-01-05 05:00:00", "99/99/2024": None,
        "2024-01-05X10:30": None, "1-2-2024 1:02am": "2024-01-02 01:02:00", "May 2024":
        "2024-05-01 00:00:00", "٣/٤/٢٠٢٤": None, "2024-01-05 10:30": "2024-01-05 10:30:00",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["d"] for r in X.with_timestamp(df, F.col("t"), "d").select(
        "t", F.col("d").cast("string").alias("d")).collect()}
    assert got == texts


def test_number_like_text(spark):
    df = spark.createDataFrame([(t,) for t in (
        "1", "-2.5", "1e5", ".5", "5.", "inf", "5d", "5f", "1 2", "abc", "")], "t string")
    got = {r["t"] for r in df.where(X.number_like(F.col("t"))).collect()}
    assert got == {"1", "-2.5", "1e5", ".5", "5.", "inf"}


@pytest.mark.parametrize("ranges", [1, 7, 60])
def test_quantiles_match_numpy(spark, ranges):
    rng = np.random.default_rng(7)
    skewed = np.where(rng.random(4000) < 0.35, 5.0, rng.lognormal(3, 2, 4000)).round(3)
    wide = rng.normal(size=4000)
    df = spark.createDataFrame(
        [(float(a), float(b), None if i % 3 else float(b)) for i, (a, b) in
         enumerate(zip(skewed, wide))], "a double, b double, c double").repartition(5)
    probabilities = (0.01, 0.25, 0.5, 0.75, 0.999)
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = {r["column"]: r["quantiles"]
               for r in L.quantiles(df, None, probabilities).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    for name, values in (("a", skewed), ("b", wide), ("c", wide[::3])):
        assert got[name] == pytest.approx(np.quantile(values, probabilities), rel=1e-12)


def test_duplicates_treat_nulls_as_equal(spark):
    data = [(1, None), (1, None), (None, "a"), (None, "a"), (None, "a"), (2, "a"), (None, None)]
    df = spark.createDataFrame(data, "x int, y string")
    for by_digest in (False, True):
        got = V.duplicate_rows(df, by_digest).first()
        assert (got["row_count"], got["duplicate_row_count"]) == (7, 3)


def test_digest_keeps_rows_apart(spark):
    df = spark.createDataFrame(
        [("a", "bc"), ("ab", "c"), ("abc", None), (None, "abc"), ("~", None), (None, "~")],
        "x string, y string")
    assert V.duplicate_rows(df, True).first()["duplicate_row_count"] == 0


def test_long_text_is_counted_exactly(spark, rows):
    long = "x" * 80
    df = spark.createDataFrame([(long + "1",), (long + "1",), (long + "2",), ("s",)], "t string")
    got = rows(A.column_facts(df), "column")["t"]
    assert (got["unique_count"], got["top_count"], got["rare_count"]) == (3, 2, 2)
    top = V.top_values(df).orderBy("rank").collect()
    assert top[0]["value"] == long + "1" and top[0]["percentage"] == 50.0


def test_value_text_by_type(spark):
    df = spark.createDataFrame([(True, 1.5, 7)], "b boolean, d double, i int").selectExpr(
        "*", "DATE'2024-02-03' AS day", "TIMESTAMP'2024-02-03 04:05:06' AS at",
        "CAST(1.10 AS DECIMAL(6,2)) AS m", "CAST(0.1 AS FLOAT) AS f")
    got = {r["column"]: r["value"] for r in V.value_frequencies(df).collect()}
    assert got == {"b": "true", "d": "1.5", "i": "7", "day": "2024-02-03",
                   "at": "2024-02-03 04:05:06", "m": "1.10", "f": "0.1"}


def test_samples_follow_the_given_order(spark):
    df = spark.createDataFrame(
        [(i, None if i % 2 else f"v{i}") for i in range(20)], "k int, v string").repartition(4)
    got = [r["value"] for r in V.sample_values(df, ["k"], ["v"]).orderBy("position").collect()]
    assert got == ["v0", "v2", "v4", "v6", "v8"]


def test_profile_has_one_block_per_kind(spark, rows):
    df = spark.createDataFrame(
        [(1.0, "a", True, "2024-01-01"), (2.0, "a", None, "2024-01-03")],
        "n double, c string, b boolean, d string")
    got = rows(R.column_profile(df, "x", order_by=["n"]), "column")
    blocks = ("numeric_stats", "categorical_stats", "datetime_stats")
    held = {c: [b for b in blocks if r[b] is not None] for c, r in got.items()}
    assert held == {"n": ["numeric_stats"], "c": ["categorical_stats"], "b": [],
                    "d": ["datetime_stats"]}
    assert got["d"]["datetime_stats"]["date_range_days"] == 2.0
    assert got["c"]["categorical_stats"]["top_values"][0]["percentage"] == 100.0
    assert got["n"]["sample_values"] == ["1.0", "2.0"]


def test_unknown_column_is_a_coded_error(spark):
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(AssayError) as caught:
        A.column_stats(df, ["y"])
    assert caught.value.code == "column_not_found"
    with pytest.raises(AssayError):
        TableProfile(df, "t").column("y")


def test_odd_names_and_partitions_do_not_matter(spark):
    data = [(i % 7 / 3.0, f"k{i % 5}") for i in range(300)]
    df = spark.createDataFrame(data, "`a.b c` double, `x``y` string")
    once = sorted(map(str, R.column_profile(df.coalesce(1), "t").collect()))
    again = sorted(map(str, R.column_profile(df.repartition(8), "t").collect()))
    assert [s.split("mean=")[0] for s in once] == [s.split("mean=")[0] for s in again]
