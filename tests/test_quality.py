from assayer.plans.table import TableProfile

INF = float("inf")


def findings(df):
    return {(r["code"], r["column"]): r.asDict() for r in TableProfile(df, "t").findings.collect()}


def test_no_columns(spark):
    got = findings(spark.createDataFrame([(1,), (1,)], "x int").select())
    assert set(got) == {("zero_columns", None)}


def test_no_rows(spark):
    got = findings(spark.createDataFrame([], "a int, b string"))
    assert set(got) == {("empty_dataset", None)}
    assert got[("empty_dataset", None)]["severity"] == "info"


def test_clean_table(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(30)], "n int, c string")
    assert findings(df) == {}


def test_missing_thresholds(spark):
    def share(missing):
        return findings(spark.createDataFrame(
            [(i, None if i < missing else i) for i in range(10)], "a int, b int"))

    assert ("column_high_missing", "b") not in share(1)
    assert share(2)[("column_high_missing", "b")]["severity"] == "warning"
    assert share(5)[("column_high_missing", "b")]["severity"] == "critical"
    empty = share(10)
    assert ("column_high_missing", "b") not in empty
    assert empty[("missing_values", None)]["severity"] == "critical"
    assert share(4)[("missing_values", None)]["severity"] == "warning"
    assert share(3)[("missing_values", None)]["severity"] == "info"


def test_constant_and_near_constant(spark):
    df = spark.createDataFrame(
        [(i, "same", "b" if i == 0 else "a") for i in range(20)], "k int, c string, n string")
    got = findings(df)
    assert got[("constant_column", "c")]["details"] == {"value": "same"}
    assert got[("near_constant_column", "n")]["metric"] == 95.0
    assert ("near_constant_column", "c") not in got


def test_cardinality_mixed_and_dates(spark):
    df = spark.createDataFrame(
        [(f"c{i}", str(i) if i < 5 else f"w{i}", "2024-01-01" if i else "?") for i in range(10)],
        "high string, mixed string, day string")
    got = findings(df)
    assert got[("high_cardinality_categorical", "high")]["metric"] == 100.0
    assert got[("mixed_type_column", "mixed")]["metric"] == 50.0
    assert got[("invalid_datetime_values", "day")]["metric"] == 1.0


def test_infinite_and_negative(spark):
    df = spark.createDataFrame(
        [(float(i), float(i) if i else INF, -1.0 * i) for i in range(5)],
        "Discount double, ratio double, balance double").withColumn(
        "average_age", -1.0 * __import__("pyspark").sql.functions.col("Discount"))
    got = findings(df)
    assert got[("infinite_values", "ratio")]["severity"] == "critical"
    assert ("unexpected_negative_values", "average_age") in got
    assert ("unexpected_negative_values", "balance") not in got
    assert ("unexpected_negative_values", "Discount") not in got


def test_order_puts_the_table_first(spark):
    df = spark.createDataFrame([(1, None), (1, None)], "a int, b int")
    got = TableProfile(df, "t").findings.orderBy("ordinal", "rule").collect()
    assert [r["code"] for r in got] == ["duplicate_rows", "missing_values", "constant_column"]
