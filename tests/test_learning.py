"""Targets, features, split, preprocessing, models and metrics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.errors import AssayError
from assayer.operators import (
    evaluate as E, facts as A, features as S, models as M, preprocess as P, split as Y,
    targets as T,
)

INF = float("inf")


def code_of(action):
    with pytest.raises(AssayError) as caught:
        action()
    return caught.value.code


# --- targets ----------------------------------------------------------------------------------

def test_suitability_and_suggestion(spark, rows):
    df = spark.createDataFrame(
        [(i % 2, i % 3, float(i), "x" if i < 5 else None, f"w{i}") for i in range(30)],
        "two int, three int, many double, few string, words string")
    facts = A.column_facts(df).persist()
    suits = {k: v["suitable"] for k, v in rows(
        T.task_suitability(facts), "column", "task").items()}
    good = {k for k, v in suits.items() if v}
    assert good == {("two", T.BINARY), ("three", T.MULTICLASS), ("three", T.REGRESSION),
                    ("many", T.REGRESSION)}
    suggested = {c: r["suggested_task"] for c, r in rows(T.suggested_task(facts), "column").items()}
    assert suggested == {"two": T.BINARY, "three": T.MULTICLASS, "many": T.REGRESSION,
                         "few": None, "words": None}


def test_validation_codes(spark):
    df = spark.createDataFrame([(
        None, 1 if i < 9 else None, 1, i % 2, 0 if i else 1, float(i), f"w{i}",
        0 if i < 2 else 1) for i in range(60)],
        "none int, few int, one int, two int, lone int, many double, words string, rare int")
    facts = A.column_facts(df).persist()

    def code(column, task):
        return code_of(lambda: T.validate_target(facts, column, task))

    assert code("absent", T.BINARY) == "target_not_found"
    assert code("none", T.BINARY) == "target_all_missing"
    assert code("few", T.REGRESSION) == "insufficient_rows"
    assert code("one", T.MULTICLASS) == "single_class_target"
    assert code("many", T.BINARY) == "invalid_target_cardinality"
    assert code("two", T.MULTICLASS) == "invalid_target_cardinality"
    assert code("lone", T.BINARY) == "insufficient_class_samples"
    assert code("words", T.REGRESSION) == "target_type_incompatible"
    assert T.validate_target(facts, "two", T.BINARY) == []
    assert len(T.validate_target(facts, "two", T.REGRESSION)) == 1
    assert "3.33%" in T.validate_target(facts, "rare", T.BINARY)[0]


# --- features and split -----------------------------------------------------------------------

def test_feature_selection(spark):
    df = spark.createDataFrame([(
        i % 2, i % 2, i % 2 if i else 1, float(i), "same", f"unique {i}", f"c{i % 3}", i % 5 == 0)
        for i in range(40)],
        "y int, copy int, near int, n double, flat string, words string, c string, b boolean")
    got = S.collect_selection(S.feature_selection(df, "y"))
    assert got.numeric == ["near", "n"] and got.categorical == ["c", "b"]
    assert got.excluded == {"copy": "duplicate_of_target", "flat": "constant_column",
                            "words": "unsupported_semantic_type:text"}
    assert S.FeatureSelection(["n"], []).transforms["categorical"] == "n/a"


def test_split_is_exact_and_does_not_depend_on_partitions(spark):
    df = spark.range(1003).withColumn("y", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))

    def tested(parts, digits, **kw):
        got = Y.split_table(df.repartition(parts), ["id"], 0.3, 5, bucket_digits=digits, **kw)
        assert got.count() == 1003
        return {(r["id"], r["y"]) for r in got.where("is_test").collect()}

    once = tested(1, 5)
    assert len(once) == math.ceil(1003 * 0.3)
    assert once == tested(7, 5) == tested(3, 1)
    by_class = tested(4, 5, label="y")
    assert by_class == tested(2, 1, label="y")
    sizes = {y: sum(1 for _, z in by_class if z == y) for y in "ab"}
    # 335 and 668 rows: 301 test rows are shared 100.53 to 200.47.
    assert sizes == {"a": 101, "b": 200}
    assert tested(1, 5) != {(r["id"], r["y"]) for r in Y.split_table(
        df, ["id"], 0.3, 6).where("is_test").collect()}


def test_constant_without_counting(spark):
    df = spark.createDataFrame([(
        i % 2, 4.0, INF, -INF if i else INF, INF if i else 4.0, None, 1.0 if i else 2.0, 7)
        for i in range(12)],
        "y int, flat double, up double, both double, mixed double, none double, two double, "
        "whole int")
    counted = A.column_facts(df)
    for facts in (None, counted):
        got = S.collect_selection(S.feature_selection(df, "y", facts))
        assert got.numeric == ["both", "mixed", "two"]
        assert set(got.excluded.values()) == {"constant_column"}


def test_as_many_classes_as_rows(spark):
    """Equal remainders go to the smaller labels."""
    df = spark.range(12).withColumn("y", F.col("id"))
    parts = Y.split_table(df, ["id"], label="y").where("is_test").collect()
    assert sorted(r["y"] for r in parts) == [0, 1, 2]
    assert Y.split_table(df.limit(0), ["id"], label="y").count() == 0


def test_split_settings(spark):
    assert code_of(lambda: Y.split_table(spark.range(5), ["id"], 1.0)) == \
        "invalid_split_configuration"
    assert code_of(lambda: Y.check_split_sizes(4, 0.2)) == "invalid_split_configuration"


# --- preprocessing ------------------------------------------------------------------------------

def test_numeric_fit(spark):
    train = spark.createDataFrame(
        [(1.0, 5.0, None), (2.0, 5.0, None), (4.0, 5.0, None), (INF, 5.0, None), (None, 5.0, None)],
        "x double, flat double, none double")
    fitted = P.fit_numeric(train, ["x", "flat", "none"])
    assert fitted.medians == {"x": 2.0, "flat": 5.0}
    filled = np.array([1, 2, 4, 2, 2.0])
    assert fitted.means["x"] == pytest.approx(filled.mean())
    assert fitted.scales["x"] == pytest.approx(filled.std()) and fitted.scales["flat"] == 1.0
    test = spark.createDataFrame([(10.0, 6.0), (None, 5.0)], "x double, flat double")
    got = fitted.transform(test).collect()
    assert got[0]["x"] == pytest.approx((10 - filled.mean()) / filled.std())
    assert got[0]["flat"] == 1.0 and got[1]["x"] == pytest.approx((2 - filled.mean()) / filled.std())


def test_categories(spark):
    train = spark.createDataFrame(
        [("b", True), ("a", False), ("a", True), ("b", None), (None, None)], "c string, f boolean")
    selection = S.FeatureSelection([], ["c", "f"])
    fitted = P.fit_preprocessor(train, selection)
    assert fitted.categorical.modes == {"c": "a", "f": "true"}
    test = spark.createDataFrame([("b", False), ("new", True), (None, None)], "c string, f boolean")
    got = [r["features"].toArray().tolist() for r in fitted.transform(test).collect()]
    assert got == [[0, 1, 1, 0], [0, 0, 0, 1], [1, 0, 0, 1]]
    told = {r["column"]: (r["fill"], r["slots"]) for r in fitted.summary(train).collect()}
    assert told == {"c": ("a", 2), "f": ("true", 2)}


def test_large_and_empty_vocabularies(spark):
    train = spark.range(5000).selectExpr(
        "concat('v', lpad(id % 3000, 5, '0')) AS c", "CAST(NULL AS STRING) AS d")
    fitted = P.fit_one_hot(train.repartition(9), ["c", "d"])
    assert fitted.sizes == [3000, 0]
    got = {r["c"]: r["c_index"] for r in fitted.indexed(train).collect()}
    assert got == {f"v{k:05d}": k for k in range(3000)}
    test = spark.createDataFrame([("v00002", "x"), ("w", None)], "c string, d string")
    hot = [(r["c_hot"].size, r["c_hot"].indices.tolist(), r["d_hot"].indices.tolist())
           for r in fitted.transform(test).orderBy("c").collect()]
    assert hot == [(3000, [2], []), (3000, [], [])]
    assert P.fit_one_hot(train, []).transform(test).columns == ["c", "d"]


# --- models -------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(240, 2)).round(4)
    y = (3 * x[:, 0] - x[:, 1] + rng.normal(scale=0.5, size=240)).round(4)
    df = spark.createDataFrame(
        [(i, float(a), float(b), float(t), "yes" if t > 0 else "no")
         for i, ((a, b), t) in enumerate(zip(x, y))],
        "id int, a double, b double, t double, c string").persist()
    return df


def arrays(data):
    def side(df):
        got = df.select("id", M.LABEL, M.FEATURES).orderBy("id").collect()
        return (np.array([r[M.FEATURES].toArray() for r in got]),
                np.array([r[M.LABEL] for r in got]))
    return side(data.train), side(data.test)


def test_linear_models_match_their_closed_forms(spark, scored):
    data = M.prepare_training(scored.drop("c"), "t", T.REGRESSION, ["id"])
    assert (data.train_size, data.test_size, data.warnings) == (192, 48, [])
    (x, y), (z, _) = arrays(data)
    centred = x - x.mean(0)
    for name, penalty in (("linear_regression", 0.0), ("ridge_regression", 1.0)):
        w = np.linalg.solve(centred.T @ centred + penalty * np.eye(2), centred.T @ (y - y.mean()))
        expected = (z - x.mean(0)) @ w + y.mean()
        got = [r["prediction"] for r in M.predict(data, name).orderBy("id").collect()]
        assert got == pytest.approx(expected, abs=1e-6)
    assert code_of(lambda: M.predict(data, "logistic_regression")) == "invalid_model_for_task"


def test_logistic_model_is_at_its_optimum(spark, scored):
    data = M.prepare_training(scored.drop("t"), "c", T.BINARY, ["id"])
    assert data.classes == ["no", "yes"]
    (x, y), (z, _) = arrays(data)
    w, b = np.zeros(2), 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        design = np.c_[x, np.ones(len(x))]
        slope = design.T @ (p - y) + np.r_[w, 0]
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1, 1, 0])
        step = np.linalg.solve(curve, slope)
        w, b = w - step[:2], b - step[2]
    expected = 1 / (1 + np.exp(-(z @ w + b)))
    predicted = M.predict(data, "logistic_regression")
    got = predicted.orderBy("id").collect()
    assert [r["probability"] for r in got] == pytest.approx(expected, abs=1e-4)
    metrics = {r["metric"]: r["value"] for r in M.model_metrics(data, predicted).collect()}
    assert set(metrics) == {"accuracy", "precision", "recall", "f1", "roc_auc"}
    assert metrics["roc_auc"] > 0.95


def test_comparison_and_determinism(spark, scored):
    data = M.prepare_training(scored.drop("t"), "c", T.BINARY, ["id"])
    once = M.compare_models(data, depth=4).collect()
    assert {r["model"] for r in once} == set(M.supported_models(T.BINARY))
    again = M.prepare_training(scored.drop("t"), "c", T.BINARY, ["id"])
    assert [r["value"] for r in M.compare_models(again, depth=4).collect()] == \
        [r["value"] for r in once]
    result = M.model_result(
        data, "logistic_regression", "d",
        M.model_metrics(data, M.predict(data, "logistic_regression"))).first()
    assert result["train_size"] == 192 and result["feature_columns"] == ["a", "b"]
    data.unpersist()


def test_three_classes_and_gaps(spark):
    df = spark.createDataFrame([(
        i, None if i % 11 == 0 else "lmh"[i % 3], float(i % 3) + (i % 5) / 10,
        None if i % 7 == 0 else f"g{i % 4}") for i in range(160)],
        "id int, y string, x double, g string")
    data = M.prepare_training(df, "y", T.MULTICLASS, ["id"])
    assert data.train_size + data.test_size == 145
    predicted = M.predict(data, "random_forest_classifier", depth=5)
    metrics = {r["metric"]: (r["value"], r["reason"])
               for r in M.model_metrics(data, predicted).collect()}
    assert metrics["accuracy"][0] > 0.9
    assert metrics["roc_auc"] == (None, E.NOT_BINARY)


def test_forest_regressor_and_no_features(spark, scored):
    data = M.prepare_training(scored.drop("c"), "t", T.REGRESSION, ["id"])
    got = {r["metric"]: r["value"] for r in M.model_metrics(
        data, M.predict(data, "random_forest_regressor", depth=6)).collect()}
    assert got["r2"] > 0.8
    bare = scored.select("id", "t")
    assert code_of(lambda: M.prepare_training(bare, "t", T.REGRESSION, ["id"])) == \
        "no_usable_features"


# --- metrics -------------------------------------------------------------------------------------

def metric_values(df):
    return {r["metric"]: r["value"] for r in df.collect()}


def test_classification_metrics(spark):
    df = spark.createDataFrame(
        [("a", "a", 0.1), ("a", "b", 0.6), ("b", "b", 0.6), ("b", "b", 0.9)],
        "label string, prediction string, p double")
    got = metric_values(E.classification_metrics(df, probability="p"))
    assert got == {"accuracy": 0.75, "precision": pytest.approx((1 + 2 / 3) / 2, abs=1e-6),
                   "recall": 0.75, "f1": pytest.approx((2 / 3 + 0.8) / 2, abs=1e-6),
                   "roc_auc": 0.875}


def test_matrix_is_square_over_all_classes(spark, rows):
    df = spark.createDataFrame([(1, 2), (1, 1), (10, 3)], "label int, prediction int")
    got = {k: v["count"] for k, v in rows(E.confusion_matrix(df), "label", "prediction").items()}
    assert len(got) == 16 and got[("1", "2")] == 1 and got[("10", "3")] == 1
    assert sum(got.values()) == 3


def test_unavailable_metrics(spark):
    one = spark.createDataFrame([("a", "a", 0.2)], "label string, prediction string, p double")
    auc = E.roc_auc(one, probability="p").first()
    assert auc["value"] is None and auc["reason"] == E.NO_PROBABILITY
    assert E.roc_auc(one).first()["reason"] == E.NO_PROBABILITY
    single = spark.createDataFrame([(1.0, 2.0)], "label double, prediction double")
    got = {r["metric"]: (r["value"], r["reason"]) for r in E.regression_metrics(single).collect()}
    assert got["mae"] == (1.0, None) and got["r2"] == (None, E.TOO_FEW_ROWS)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(3.0, 2.5), (-0.5, 0.0), (2.0, 2.0), (7.0, 8.0)],
                               "label double, prediction double")
    got = metric_values(E.regression_metrics(df))
    assert got == {"mae": 0.5, "mse": 0.375, "rmse": 0.612372, "r2": 0.948608}
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "label double, prediction double")
    assert metric_values(E.regression_metrics(flat))["r2"] == 0.0


def test_labels_and_predictions_of_two_number_types(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.0), (1, 0.0), (0, 0.0), (2, 0.5)],
                               "label int, prediction double")
    got = {r["metric"]: r["value"] for r in E.classification_metrics(df).collect()}
    assert got["accuracy"] == 0.6
    assert {(r["label"], r["prediction"]): r["count"] for r in
            E.confusion_counts(df).collect()}[("2", "0.5")] == 1


def test_area_needs_good_scores_and_two_classes(spark):
    def area(rows):
        return E.roc_auc(spark.createDataFrame(rows, "label int, p double"),
                         probability="p").first()

    assert area([(0, 0.1), (1, 0.9)])["value"] == 1.0
    for bad in (None, float("nan")):
        r = area([(0, 0.1), (1, 0.9), (1, bad)])
        assert r["value"] is None and r["reason"] == E.BAD_PROBABILITY
    assert area([(0, 0.1), (1, 0.9), (2, 0.5)])["reason"] == E.NOT_BINARY


def test_a_matrix_of_continuous_values_is_refused(spark):
    df = spark.range(2000).selectExpr("id * 0.1D AS label", "id * 0.1D AS prediction")
    with pytest.raises(AssayError) as e:
        E.confusion_matrix(df)
    assert e.value.code == "too_many_classes"


def test_split_keys_are_told_apart(spark):
    from assayer.operators.split import row_hash
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x"), ("-", "x"), ("x", None)],
                               "k string, l string")
    assert df.select(row_hash(["k", "l"], 42).alias("h")).distinct().count() == 5


def test_rows_of_one_class_are_split_by_many_tasks(spark):
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n) for n in names]
    try:
        for name, value in zip(names, ("false", "-1"), strict=True):
            spark.conf.set(name, value)
        split = Y.split_table(spark.range(1000), ["id"])
        parts = split.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(parts) == 4 and max(r["count"] for r in parts) < 500
        assert split.where("is_test").count() == 200
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)
