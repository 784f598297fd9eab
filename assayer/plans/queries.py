"""The registered queries: one per operator, each over whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from assayer.functions import text as X
from assayer.operators import (
    correlation as C, distribution as D, evaluate as E, evidence as V, facts as A,
    features as S, forest, frequencies as Q, graph as G, linear, models as M, narrate as N, preprocess as P,
    profile as R, quality, questions as K, split as Y, targets as T,
)
from assayer.plans.inputs import source, table
from assayer.plans.table import TableProfile, together
from assayer.session import scratch_path
from assayer.sources import csv, screens
from assayer.sources.catalog import Catalog

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def _profile(spark, sf_dir, name) -> TableProfile:
    return TableProfile(source(spark, sf_dir, name), name)


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show; zoneless times."""
    shown = {
        "double": lambda c: F.round(c, digits),
        "timestamp": lambda c: F.col(c).cast("timestamp_ntz"),
    }
    return df.select(*[
        shown.get(f.dataType.typeName(), F.col)(f.name).alias(f.name)
        for f in df.schema.fields
    ])


# --- frequencies and profiles -------------------------------------------------------------

@query
def numeric_profile(spark, sf_dir):
    return _rounded(R.numeric_profile(source(spark, sf_dir, "lineitem")))


@query
def numeric_profile_gaps(spark, sf_dir):
    """Gaps, NaN and both infinities."""
    return _rounded(R.numeric_profile(source(spark, sf_dir, "messy_orders")))


@query
def value_frequencies(spark, sf_dir):
    """Doubles as text with four digits, since engines write them differently."""
    df = source(spark, sf_dir, "gappy_lineitem")
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return Q.value_frequencies(df).withColumn("value", F.when(
        F.col("column").isin(doubles), F.format_string("%.4f", F.col("value").try_cast("double"))
    ).otherwise(F.col("value")))


@query
def column_stats(spark, sf_dir):
    return _rounded(A.column_stats(source(spark, sf_dir, "messy_orders")))


@query
def column_common(spark, sf_dir):
    return R.column_common(A.column_facts(source(spark, sf_dir, "messy_orders")))


@query
def semantic_types(spark, sf_dir):
    return R.semantic_types(A.column_facts(source(spark, sf_dir, "messy_orders")))


@query
def datetime_layouts(spark, sf_dir):
    """Every layout read back to the day, or month, that it says."""
    dated = X.with_timestamp(source(spark, sf_dir, "dated_orders"), F.col("written"), "read")
    return dated.select("o_orderkey", F.col("read").cast("timestamp_ntz").alias("read"))


@query
def categorical_profile(spark, sf_dir):
    return R.categorical_profile(A.column_facts(source(spark, sf_dir, "messy_orders")))


@query
def datetime_profile(spark, sf_dir):
    return _rounded(R.datetime_profile(A.column_facts(source(spark, sf_dir, "messy_orders"))))


@query
def top_values(spark, sf_dir):
    return Q.top_values(source(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"])


@query
def top_values_gaps(spark, sf_dir):
    return Q.top_values(
        source(spark, sf_dir, "messy_orders"), ["order_day", "mixed", "nearly", "sparse"])


@query
def sample_values(spark, sf_dir):
    return Q.sample_values(source(spark, sf_dir, "customer"), ["c_custkey"])


@query
def duplicate_rows(spark, sf_dir):
    return Q.duplicate_rows(source(spark, sf_dir, "repeated_lines"))


@query
def duplicate_texts(spark, sf_dir):
    """Whole documents compared by digest."""
    return Q.duplicate_rows(table(spark, sf_dir, "documents").select("text", "lang"), True)


@query
def missing_summary(spark, sf_dir):
    return R.missing_summary(A.column_stats(source(spark, sf_dir, "gappy_lineitem")))


@query
def structural_facts(spark, sf_dir):
    return R.structural_facts(source(spark, sf_dir, "repeated_lines"))


@query
def logical_size(spark, sf_dir):
    return R.logical_size(A.column_stats(source(spark, sf_dir, "messy_orders")))


@query
def dataset_profile(spark, sf_dir):
    """Needs no distinct counts, so none are made."""
    df = source(spark, sf_dir, "repeated_lines")
    return R.dataset_profile(df, "repeated_lines", A.column_stats(df))


@query
def eligible_columns(spark, sf_dir):
    """Eligible columns with the values each brings to the correlation."""
    df = source(spark, sf_dir, "messy_orders")
    return R.eligible_columns(df).join(
        A.column_stats(df).select("column", "non_null_count"), "column")


@query
def column_profile(spark, sf_dir):
    """The blocks of a full profile, flattened."""
    df = source(spark, sf_dir, "messy_orders")
    n, k, t = "numeric_stats", "categorical_stats", "datetime_stats"
    return _rounded(R.column_profile(df, "messy_orders", order_by=["o_orderkey"]).select(
        "dataset_id", "ordinal", "column", "semantic_type", "null_count", "unique_count",
        F.size("sample_values").cast("bigint").alias("samples"),
        F.col(f"{n}.median").alias("median"), F.col(f"{n}.iqr").alias("iqr"),
        F.col(f"{n}.infinite_count").alias("infinite_count"),
        F.col(f"{k}.cardinality").alias("cardinality"),
        F.try_element_at(f"{k}.top_values", F.lit(1))["value"].alias("top_value"),
        F.col(f"{k}.rare_value_count").alias("rare_value_count"),
        F.col(f"{t}.min_date").alias("min_date"),
        F.col(f"{t}.unparseable_count").alias("unparseable_count")))


# --- correlation and distribution ---------------------------------------------------------

@query
def correlation(spark, sf_dir):
    return C.correlation(source(spark, sf_dir, "gappy_lineitem")).drop("a", "b")


@query
def correlation_complete(spark, sf_dir):
    """No gaps: plain aggregates."""
    return C.correlation(source(spark, sf_dir, "lineitem")).drop("a", "b")


@query
def correlation_wide(spark, sf_dir):
    """Several blocks of columns, most of them with gaps of their own."""
    return C.correlation(source(spark, sf_dir, "wide_lineitem")).drop("a", "b")


@query
def correlation_status(spark, sf_dir):
    """One table with pairs, one with a single numeric column."""
    full = source(spark, sf_dir, "messy_orders")
    single = table(spark, sf_dir, "documents").select("n_chars", "lang")
    return C.correlation_status(full, C.correlation(full)).unionAll(
        C.correlation_status(single, C.correlation(single)))


@query
def correlation_outlier(spark, sf_dir):
    """A gap beside an outlier: each pair has rows, and so means, of its own."""
    return C.correlation(source(spark, sf_dir, "outlying")).drop("a", "b")


@query
def correlation_strength(spark, sf_dir):
    pairs = C.correlation(source(spark, sf_dir, "part"))
    return pairs.select("column_a", "column_b", C.strength(F.col("coefficient"))
                        .alias("strength"))


@query
def top_correlations(spark, sf_dir):
    pairs = C.correlation(source(spark, sf_dir, "lineitem"))
    return V.evidence_correlation(quality.with_dataset(pairs, "lineitem"))


@query
def strongest_pair(spark, sf_dir):
    pairs = C.correlation(source(spark, sf_dir, "part"))
    return K.strongest_pair(quality.with_dataset(pairs, "part"))


@query
def histogram(spark, sf_dir):
    return _rounded(D.histogram(source(spark, sf_dir, "lineitem")), 6)


@query
def histogram_gaps(spark, sf_dir):
    return _rounded(D.histogram(source(spark, sf_dir, "messy_orders")), 6)


@query
def histogram_skipped(spark, sf_dir):
    return D.histogram_skipped(source(spark, sf_dir, "messy_orders"))


# --- quality ------------------------------------------------------------------------------

def _detailed(findings):
    """Findings with their details as text."""
    return findings.withColumn("details", F.array_join(F.transform(
        F.array_sort(F.map_entries("details")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))


@query
def quality_findings(spark, sf_dir):
    return _detailed(_profile(spark, sf_dir, "messy_orders").findings)


@query
def quality_duplicates(spark, sf_dir):
    return _detailed(_profile(spark, sf_dir, "repeated_lines").findings)


@query
def quality_severity_counts(spark, sf_dir):
    return _profile(spark, sf_dir, "messy_orders").severities


@query
def worst_missing_column(spark, sf_dir):
    return K.worst_missing_column(_profile(spark, sf_dir, "messy_orders").facts)


# --- targets, features, split, preprocessing -----------------------------------------------

@query
def target_facts(spark, sf_dir):
    return T.target_facts(A.column_facts(source(spark, sf_dir, "feature_orders")))


@query
def task_suitability(spark, sf_dir):
    return T.task_suitability(A.column_facts(source(spark, sf_dir, "feature_orders")))


@query
def suggested_task(spark, sf_dir):
    return T.suggested_task(A.column_facts(source(spark, sf_dir, "feature_orders")))


@query
def target_validation(spark, sf_dir):
    return T.target_validation(A.column_facts(source(spark, sf_dir, "messy_orders"))).select(
        "ordinal", "column", "task", "error")


@query
def target_warnings(spark, sf_dir):
    checked = T.target_validation(A.column_facts(source(spark, sf_dir, "messy_orders")))
    return checked.select("column", "task", F.explode("warnings").alias("warning"))


@query
def class_distribution(spark, sf_dir):
    return T.class_distribution(source(spark, sf_dir, "feature_orders"), "status")


@query
def usable_rows(spark, sf_dir):
    return T.usable_rows(source(spark, sf_dir, "feature_orders"), "status").select(
        "o_orderkey", "status")


@query
def feature_selection(spark, sf_dir):
    usable = T.usable_rows(source(spark, sf_dir, "feature_orders"), "status")
    return S.feature_selection(usable, "status")


@query
def training_warnings(spark, sf_dir):
    usable = T.usable_rows(source(spark, sf_dir, "feature_orders"), "status")
    return S.training_warnings(S.feature_selection(usable, "status"), usable.count())


@query
def train_test_split(spark, sf_dir):
    return Y.split_table(source(spark, sf_dir, "orders"), ["o_orderkey"]).select(
        "o_orderkey", "is_test")


@query
def stratified_split(spark, sf_dir):
    return Y.split_table(
        source(spark, sf_dir, "feature_orders"), ["o_orderkey"], label="status"
    ).select("o_orderkey", "status", "is_test")


@query
def preprocess_numeric(spark, sf_dir):
    """Learned on the training rows of the split, applied to all rows."""
    df = source(spark, sf_dir, "messy_orders")
    parts = Y.split_table(df.select("o_orderkey", "total_amount", "ratio"), ["o_orderkey"]).persist()
    fitted = P.fit_numeric(parts.where(~F.col("is_test")), ["total_amount", "ratio"])
    return _rounded(fitted.transform(parts, "scaled_").select(
        "o_orderkey", "scaled_total_amount", "scaled_ratio"), 5)


@query
def preprocess_categorical(spark, sf_dir):
    df = source(spark, sf_dir, "messy_orders")
    fitted = P.fit_categorical(df, ["sparse", "nearly"])
    return fitted.transform(df, "filled_").select("o_orderkey", "filled_sparse", "filled_nearly")


@query
def one_hot(spark, sf_dir):
    """Slots learned without status P, which then sets none."""
    df = source(spark, sf_dir, "orders")
    fitted = P.fit_one_hot(df.where("o_orderstatus <> 'P'"), ["o_orderstatus", "o_orderpriority"])
    slots = fitted.transform(df)
    return slots.select(
        "o_orderkey", _slot("o_orderstatus_hot").alias("status_slot"),
        _slot("o_orderpriority_hot").alias("priority_slot"),
        F.size(vector_to_array("o_orderstatus_hot")).cast("bigint").alias("status_slots"))


def _slot(name):
    hot = F.array_position(vector_to_array(name), 1.0)
    return F.when(hot > 0, hot - 1).cast("bigint")


@query
def one_hot_wide(spark, sf_dir):
    """Slots of all text columns of the parts, learned on the cheaper half of them; names are
    nearly all different."""
    df = table(spark, sf_dir, "part")
    names = ["p_name", "p_brand", "p_type"]
    fitted = P.fit_one_hot(df.where("p_retailprice < 1000"), names)
    return fitted.indexed(df).select("p_partkey", *[f"{n}_index" for n in names], *[
        F.lit(size).cast("bigint").alias(f"{n}_slots")
        for n, size in zip(names, fitted.sizes)])


@query
def preprocessing_summary(spark, sf_dir):
    """What is learned for each feature of the orders from their training rows."""
    data = _status(spark, sf_dir)
    return data.preprocessor.summary(data.train).select(
        "column", "role", "transform", "fill", F.round("mean", 4).alias("mean"),
        F.round("scale", 4).alias("scale"), "slots")


# --- models and metrics ---------------------------------------------------------------------

def _toxic(spark, sf_dir):
    """The text goes along: selection leaves it out and says so."""
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return M.prepare_training(joined, "toxic", T.BINARY, ["doc_id"])


def _priced(spark, sf_dir):
    return M.prepare_training(
        table(spark, sf_dir, "orders"), "o_totalprice", T.REGRESSION, ["o_orderkey"])


def _status(spark, sf_dir):
    return M.prepare_training(
        table(spark, sf_dir, "orders"), "o_orderstatus", T.MULTICLASS, ["o_orderkey"])


def _classes_checked(data, name):
    """Test rows with what must hold of every classifier: a known class, a probability, and
    over the training rows fewer errors than the most frequent class makes.
    """
    rows = M.predict(data, name, on="both")
    train = F.col("is_test") == False  # noqa: E712
    wrong = F.count_if(train & (F.col("prediction") != F.col("label")))
    least = F.least(*[F.count_if(train & (F.col("label") != F.lit(c))) for c in data.classes])
    ones = F.avg(F.when(train, (F.col("label") == F.lit(data.classes[-1])).cast("double")))
    mean = F.avg(F.when(train, F.col("probability")))
    fit = rows.agg((wrong <= least).alias("learned"),
                   (F.abs(mean - ones) < 0.05).alias("calibrated")).first()
    return rows.where("is_test").select(
        "doc_id", "label", F.col("prediction").isin(data.classes).alias("known_class"),
        F.col("probability").between(0.0, 1.0).alias("is_probability"),
        *[F.lit(fit[n]).alias(n) for n in ("learned", "calibrated")])


@query
def model_predictions_logistic_regression(spark, sf_dir):
    """At the optimum the mean probability of the training rows is the share of the class."""
    return _classes_checked(_toxic(spark, sf_dir), "logistic_regression")


@query
def model_predictions_random_forest_classifier(spark, sf_dir):
    return _classes_checked(_toxic(spark, sf_dir), "random_forest_classifier")


def _balance(spark, sf_dir):
    """One number and one category to learn from; the name is text."""
    return M.prepare_training(
        table(spark, sf_dir, "customer"), "c_acctbal", T.REGRESSION, ["c_custkey"])


def _valued(spark, sf_dir):
    """A number and two categories with a hundred values and more."""
    return M.prepare_training(table(spark, sf_dir, "events"), "value", T.REGRESSION, ["event_id"])


@query
def model_predictions_linear_regression(spark, sf_dir):
    """The slope within categories and their means are a closed form of this fit."""
    return _rounded(M.predict(_balance(spark, sf_dir), "linear_regression"), 3)


def _optimum_checked(data, penalty):
    """Test rows with whether the fit meets its normal equations: over the training rows, every
    feature's product with the residuals is the penalty times its coefficient."""
    model = linear.fit(data.train, P.FEATURES, M.LABEL, penalty)
    rows = model.transform(data.train.withColumn("_x0", F.col(P.FEATURES)), P.FEATURES)
    rest = F.col(M.LABEL) - F.col("prediction")
    products = rows.select(rest.alias("r"), F.posexplode(vector_to_array("_x0")).alias(
        "slot", "x")).groupBy("slot").agg(F.sum(F.col("x") * F.col("r")).alias("product"))
    weights = data.train.sparkSession.createDataFrame(
        [(k, float(w)) for k, w in enumerate(model.coefficients)], "slot int, weight double")
    gap = products.join(weights, "slot").agg(F.max(F.abs(
        F.col("product") - penalty * F.col("weight")))).first()[0]
    return model.transform(data.test, P.FEATURES), gap < 1e-6 * data.train_size


@query
def model_predictions_ridge_regression(spark, sf_dir):
    """Each test row's prediction, and whether the fit is the best one."""
    rows, optimal = _optimum_checked(_valued(spark, sf_dir), 1.0)
    return rows.select("event_id", F.round("label", 4).alias("label"),
                       F.round("prediction", 4).alias("prediction"),
                       F.lit(optimal).alias("optimal"))


@query
def linear_regression_wide(spark, sf_dir):
    """Least squares over collinear slots of several categories."""
    rows, optimal = _optimum_checked(_valued(spark, sf_dir), 0.0)
    return rows.select("event_id", F.round("label", 4).alias("label"),
                       F.lit(optimal).alias("optimal"))


@query
def model_predictions_random_forest_regressor(spark, sf_dir):
    """Test rows with what must hold: a prediction within the labels of the training rows,
    and an error over those below that of their mean."""
    rows = M.predict(_priced(spark, sf_dir), "random_forest_regressor", on="both")
    train = F.col("is_test") == False  # noqa: E712
    label = F.when(train, F.col("label"))
    error = F.when(train, F.pow(F.col("label") - F.col("prediction"), F.lit(2)))
    fit = rows.agg(F.min(label).alias("low"), F.max(label).alias("high"),
                   (F.avg(error) < F.var_pop(label)).alias("learned")).first()
    return rows.where("is_test").select(
        "o_orderkey", "label", F.col("prediction").between(fit["low"], fit["high"])
        .alias("in_range"), F.lit(fit["learned"]).alias("learned"))


@query
def forest_exact_fit(spark, sf_dir):
    """A tree tells every row that it saw exactly, unless others have the same features."""
    data = _priced(spark, sf_dir)
    grown = forest.grow(data.train, P.FEATURES, M.LABEL, ["o_orderkey"], trees=1,
                        all_features=True, task_rows=2000)
    seen = forest.in_bag(data.train, ["o_orderkey"], 0)
    alike = Window.partitionBy(vector_to_array(P.FEATURES))
    told = grown.predict(seen.withColumn("alone", F.count(F.lit(1)).over(alike) == 1),
                         P.FEATURES)
    exact = F.abs(F.col("votes")[0] - F.col(M.LABEL)) <= 1e-9 * F.abs(F.col(M.LABEL))
    return told.select("o_orderkey", "alone",
                       (~F.col("in_bag") | ~F.col("alone") | exact).alias("fitted"))


@query
def model_comparison(spark, sf_dir):
    """Sizes and reasons as they are; each value as whether it is a share."""
    return M.compare_models(_status(spark, sf_dir)).select(
        "model", "metric", F.col("value").between(0.0, 1.0).alias("is_share"), "reason",
        "train_size", "test_size")


@query
def model_result(spark, sf_dir):
    """Settings, sizes and the confusion matrix of a run; its counts add up to the test rows,
    with every class on either side."""
    data = _status(spark, sf_dir)
    predicted = M.predict(data, "logistic_regression")
    result = M.model_result(data, "logistic_regression", "orders",
                            M.model_metrics(data, predicted), predicted)
    cells = F.col("confusion_matrix")
    return result.select(
        "dataset_id", "target_column", "task_type", "model_name",
        F.array_join("feature_columns", ",").alias("features"), "train_size",
        "test_size_actual", "test_share", "seed", "stratified", "depth",
        F.size(cells).cast("bigint").alias("cells"),
        F.aggregate(cells, F.lit(0).cast("bigint"), lambda n, c: n + c["count"])
        .alias("counted"),
        F.array_join(F.array_sort(F.map_keys("unavailable_metrics")), ",").alias("missing"))


@query
def classification_metrics(spark, sf_dir):
    return E.classification_metrics(
        source(spark, sf_dir, "flag_predictions"), probability="probability")


@query
def classification_metrics_multiclass(spark, sf_dir):
    return E.classification_metrics(source(spark, sf_dir, "status_predictions"), T.MULTICLASS)


@query
def classification_metrics_numeric(spark, sf_dir):
    """Whole labels against predictions of doubles."""
    return E.classification_metrics(source(spark, sf_dir, "number_predictions"))


@query
def roc_auc_invalid(spark, sf_dir):
    return E.roc_auc(source(spark, sf_dir, "odd_scores"), probability="probability")


@query
def confusion_matrix(spark, sf_dir):
    return E.confusion_matrix(source(spark, sf_dir, "status_predictions"))


@query
def roc_auc(spark, sf_dir):
    return E.roc_auc(source(spark, sf_dir, "flag_predictions"), probability="probability")


@query
def regression_metrics(spark, sf_dir):
    return E.regression_metrics(source(spark, sf_dir, "price_predictions"))


# --- sources -------------------------------------------------------------------------------

@query
def csv_ingest(spark, sf_dir):
    """A table with gaps, written as delimited text and read back with its types."""
    path = scratch_path(spark, "customer-csv")
    table(spark, sf_dir, "customer").withColumn(
        "c_acctbal", F.expr("CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END")
    ).withColumn("c_mktsegment", F.expr(
        "CASE WHEN c_custkey % 6 = 0 THEN 'NA' ELSE c_mktsegment END")
    ).write.option("header", True).csv(path)
    return csv.ingest_csv(spark, path)


@query
def csv_encodings(spark, sf_dir):
    """One folder, files in two encodings, names that are written differently in them."""
    path = scratch_path(spark, "mixed-csv")
    named = table(spark, sf_dir, "customer").withColumn(
        "c_name", F.concat("c_name", F.lit(" Jos\u00e9 \u00df")))
    for odd, encoding in ((0, "UTF-8"), (1, "ISO-8859-1")):
        named.where(F.col("c_custkey") % 2 == odd).write.mode("append").option(
            "header", True).option("encoding", encoding).csv(path)
    return csv.ingest_csv(spark, path).select("c_custkey", "c_name")


@query
def csv_quoted(spark, sf_dir):
    """Texts with line breaks, commas and quotes inside, cut into records by many tasks."""
    path = scratch_path(spark, "quoted-csv")
    table(spark, sf_dir, "conversations").withColumn(
        "text", F.expr("replace(replace(text, '. ', '.\n'), ' the ', ' \"the\", ')")
    ).write.option("header", True).option("quoteAll", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return csv.ingest_csv(spark, path)


@query
def infer_types(spark, sf_dir):
    return csv.infer_types(source(spark, sf_dir, "text_orders"))


@query
def malformed_rows(spark, sf_dir):
    """Lines with a field too many, among lines with one too few and proper ones."""
    path = scratch_path(spark, "ragged-csv")
    line = F.expr(
        "CASE WHEN c_custkey % 13 = 0 THEN concat_ws(',', c_custkey, c_name, c_mktsegment, 'x') "
        "WHEN c_custkey % 13 = 1 THEN concat_ws(',', c_custkey, c_name) "
        "ELSE concat_ws(',', c_custkey, c_name, c_mktsegment) END")
    table(spark, sf_dir, "customer").select(line.alias("key,name,segment")).write.option(
        "header", True).option("sep", "\u0001").csv(path)
    layout = csv.detect_layout(spark, path)
    return csv.malformed_rows(csv.read_text(spark, path, layout)).select(
        "line", F.col("field_count").cast("bigint").alias("field_count"))


@query
def file_screen(spark, sf_dir):
    return screens.file_screen(source(spark, sf_dir, "uploads"))


@query
def binary_screen(spark, sf_dir):
    """Content in UTF-8, and in Latin-1 where the text allows it, by rule."""
    latin = F.encode("text", "ISO-8859-1")
    content = F.when((F.col("doc_id") % 2 == 0) & (F.decode(latin, "ISO-8859-1")
                                                  == F.col("text")), latin) \
        .otherwise(F.encode("text", "UTF-8"))
    return source(spark, sf_dir, "uploads").select(
        "path", "length", screens.content_verdict(content).alias("verdict"))


@query
def catalog(spark, sf_dir):
    """Three registered tables, listed and reopened."""
    store = Catalog(spark, scratch_path(spark, "catalog"))
    for name in ("customer", "part", "supplier"):
        store.register(table(spark, sf_dir, name), f"{name}.parquet", name)
    reopened = store.load("part").agg(F.count(F.lit(1)))
    return store.entries().select(
        "id", "original_filename", "row_count", F.col("column_count").cast("bigint")
        .alias("column_count"), "missing_value_count", "duplicate_row_count",
        F.when(F.col("id") == "part", reopened.scalar()).alias("reopened_rows"))


# --- evidence, narration, questions, graph --------------------------------------------------

@query
def evidence_summary(spark, sf_dir):
    tables = [_profile(spark, sf_dir, n) for n in ("messy_orders", "repeated_lines")]
    return V.evidence_summary(
        together(tables, "dataset"), together(tables, "facts"), together(tables, "severities")
    ).withColumn("columns", F.size("columns").cast("bigint")).withColumn(
        "column_count", F.col("column_count").cast("bigint"))


@query
def evidence_quality(spark, sf_dir):
    messy = _profile(spark, sf_dir, "messy_orders")
    return V.evidence_quality(messy.findings, messy.dataset)


@query
def evidence_column(spark, sf_dir):
    row = V.evidence_column(_profile(spark, sf_dir, "gappy_lineitem").columns, "l_tax")
    return _rounded(row.select(
        "dataset_id", "column", "semantic_type", "null_count", "null_percentage",
        "unique_count", F.col("numeric_stats.mean").alias("mean"),
        F.col("numeric_stats.median").alias("median"), F.col("numeric_stats.std").alias("std")))


@query
def evidence_model(spark, sf_dir):
    """A result per event type as JSON; that of one type lacks its metrics."""
    scores = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.abs(F.col("value") - 30.0)), 4).alias("mae"))
    body = [
        F.lit("regression").alias("task_type"), F.lit("value").alias("target_column"),
        F.lit("fixed").alias("model_name"), F.array(F.lit("user_id")).alias("feature_columns"),
        F.col("n").alias("train_size"), F.col("n").alias("test_size_actual")]
    scored = F.to_json(F.struct(*body, F.create_map(F.lit("mae"), F.col("mae")).alias("metrics")))
    results = scores.select("event_type", F.when(
        F.col("event_type") == "error", F.to_json(F.struct(*body))).otherwise(scored)
        .alias("result"))
    return V.evidence_model(results).select(
        "event_type", "error", F.array_join("missing_fields", ",").alias("missing"),
        "model_name", "train_size", F.col("metrics")["mae"].alias("mae"))


@query
def narrate_profile(spark, sf_dir):
    tables = [_profile(spark, sf_dir, n) for n in ("messy_orders", "repeated_lines")]
    return N.narrate_summary(V.evidence_summary(
        together(tables, "dataset"), together(tables, "facts"),
        together(tables, "severities")))


@query
def narrate_quality(spark, sf_dir):
    return N.narrate_quality(V.evidence_quality(_profile(spark, sf_dir, "repeated_lines").findings))


@query
def quality_empty(spark, sf_dir):
    """The orders without their rows, and without their columns."""
    orders = table(spark, sf_dir, "orders")
    tables = [TableProfile(orders.where("o_orderkey IS NULL"), "no_rows"),
              TableProfile(orders.select(), "no_columns")]
    return together(tables, "findings").select(
        "dataset_id", "ordinal", "rule", "code", "severity", "column", "message")


@query
def target_edges(spark, sf_dir):
    """Targets without values, with too few rows, and with a class of one row."""
    edges = source(spark, sf_dir, "edge_orders")
    return T.target_validation(A.column_facts(edges)).select(
        "ordinal", "column", "task", "error")


@query
def narrate_quality_clean(spark, sf_dir):
    """A table that breaks no rule."""
    clean = _profile(spark, sf_dir, "part")
    return N.narrate_quality(V.evidence_quality(clean.findings, clean.dataset))


@query
def narrate_columns(spark, sf_dir):
    return N.narrate_column(_profile(spark, sf_dir, "part").columns)


@query
def narrate_correlation(spark, sf_dir):
    part = _profile(spark, sf_dir, "part")
    return N.narrate_correlation(V.evidence_correlation(part.pairs), part.correlation_status)


@query
def narrate_model(spark, sf_dir):
    data = _balance(spark, sf_dir)
    metrics = M.model_metrics(data, M.predict(data, "linear_regression"))
    result = M.model_result(data, "linear_regression", "customer", metrics)
    return N.narrate_model(V.require_model_result(V.evidence_model(
        result.select("dataset_id", F.to_json(F.struct(*[
            c for c in result.columns if c != "dataset_id"])).alias("result")))))


def _routed(spark, sf_dir):
    orders = TableProfile(source(spark, sf_dir, "asked_orders"), "orders")
    part = TableProfile(table(spark, sf_dir, "part"), "part")
    both = [orders, part]
    scores = E.classification_metrics(source(spark, sf_dir, "flag_predictions"))
    models = scores.where("value IS NOT NULL").groupBy(
        F.lit("orders").alias("dataset_id"), F.lit("fixed").alias("model_name")).agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))
    return source(spark, sf_dir, "asked"), together(both, "dataset"), \
        together(both, "numeric"), together(both, "pairs"), models


@query
def route_questions(spark, sf_dir):
    return K.route_questions(*_routed(spark, sf_dir))


@query
def route_column_stat(spark, sf_dir):
    asked, _, columns, _, _ = _routed(spark, sf_dir)
    return _rounded(K.route_column_statistic(asked, columns))


@query
def narrate_answers(spark, sf_dir):
    return N.narrate_answer(K.route_questions(*_routed(spark, sf_dir)))


@query
def feature_nodes(spark, sf_dir):
    return _profile(spark, sf_dir, "messy_orders").nodes


@query
def correlation_edges(spark, sf_dir):
    return _profile(spark, sf_dir, "lineitem").edges


@query
def correlated_columns(spark, sf_dir):
    return G.correlated_columns(_profile(spark, sf_dir, "lineitem").edges)


@query
def analytics_nodes(spark, sf_dir):
    messy = _profile(spark, sf_dir, "messy_orders")
    return G.analytics_nodes(messy.edges, messy.facts, messy.findings)


@query
def column_search(spark, sf_dir):
    """Among more columns than a graph shows."""
    return G.column_search(_profile(spark, sf_dir, "wide_lineitem").all_nodes, "  C6 ")


@query
def column_filter(spark, sf_dir):
    """Gaps, or findings, or a correlated pair, or a feature of the model."""
    messy = _profile(spark, sf_dir, "messy_orders")
    usable = T.usable_rows(source(spark, sf_dir, "feature_orders"), "status")
    model = S.feature_selection(usable, "status").where("role <> 'excluded'").select(
        F.lit("messy_orders").alias("dataset_id"), "column")
    return G.column_filter(
        messy.all_nodes, missing=True, quality=True,
        correlated=G.correlated_columns(messy.edges), model_columns=model)


@query
def column_filter_kind(spark, sf_dir):
    nodes = _profile(spark, sf_dir, "messy_orders").all_nodes
    return G.column_filter(nodes, categorical=True, query="e")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
