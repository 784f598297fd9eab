"""Routing of many simple questions to already computed facts, by fixed ordered rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.text import shown

LOOKUP = "deterministic_lookup"
EXPLANATION = "explanation"
INTERPRETATION = "analytical_interpretation"
UNSUPPORTED = "unsupported"

# Fixed words, tried in this order, and the statistic each asks for.
STATISTIC_WORDS = (
    ("average", "mean"), ("mean", "mean"), ("median", "median"), ("minimum", "min"),
    ("min", "min"), ("maximum", "max"), ("max", "max"), ("standard deviation", "std"),
)
STATISTICS = ("mean", "median", "min", "max", "std")
METRIC_WORDS = (
    "f1", "accuracy", "precision", "recall", "rmse", "r2", "r-squared", "mae", "mse",
    "model perform", "baseline model", "how did the model",
)
MOST_WORDS = ("most", "which", "highest")
STRONG_WORDS = ("strong", "most", "which", "highest")
ISSUE_WORDS = ("issue", "problem")


def _has(text: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def asked_statistic(text: Column) -> Column:
    """The statistic asked for in a lower-case question, or NULL."""
    return F.coalesce(*[
        F.when(F.contains(text, F.lit(word)), F.lit(stat)) for word, stat in STATISTIC_WORDS])


def _with_statistic(questions: DataFrame, columns: DataFrame) -> DataFrame:
    """``questions`` with ``stat``: (column, statistic, value), or NULL.

    One row per dataset holds its columns, each with the first word of its name. A question
    meets that row once and looks through the columns whose first word it contains, so its
    text is neither copied nor shuffled for this.
    """
    name = F.lower("column")
    # Quoting the name keeps its special characters from acting as a pattern.
    quoted = F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    stats = F.col("numeric_stats")
    listed = columns.withColumn("word", F.regexp_extract(name, r"(?U)\w+", 0)) \
        .where(F.col("word") != "").groupBy("dataset_id").agg(F.array_sort(F.collect_list(
            F.struct(
                "ordinal", "column", "word", "semantic_type",
                F.concat(F.lit(r"(?U)\b\Q"), quoted, F.lit(r"\E\b")).alias("pattern"),
                *[stats[s].alias(s) for s in STATISTICS]))).alias("_columns"))
    # A dataset has as many columns as its table: few rows of bounded width.
    asked = questions.join(listed, "dataset_id", "left").withColumns({
        "_q": F.lower("question"), "_statistic": asked_statistic(F.lower("question"))})
    words = F.when(F.col("_statistic").isNotNull(), F.array_intersect(
        F.split("_q", r"(?U)\W+"), F.transform("_columns", lambda c: c["word"])))
    named = F.filter("_columns", lambda c: F.array_contains(F.col("_words"), c["word"])
                     & F.rlike(F.col("_q"), c["pattern"]))
    first = F.get(named, F.lit(0))
    value = reduce(
        lambda rest, stat: F.when(F.col("_statistic") == stat, F.col("_first")[stat])
        .otherwise(rest), STATISTICS, F.lit(None).cast("double"))
    return asked.withColumn("_words", words).withColumn(
        "_first", F.when(F.size("_words") > 0, first)).withColumn("_value", value).withColumn(
        "stat", F.when(
            (F.col("_first.semantic_type") == "numeric") & F.col("_value").isNotNull(),
            F.struct(F.col("_first.column").alias("column"),
                     F.col("_statistic").alias("statistic"), F.col("_value").alias("value")))
    ).select(*[F.col(f"`{c}`") for c in questions.columns], "stat")


def route_column_statistic(questions: DataFrame, columns: DataFrame) -> DataFrame:
    """(dataset_id, question_id, column, statistic, value): a statistic of a named numeric
    column.

    ``columns`` is (dataset_id, ordinal, column, semantic_type, numeric_stats). A column
    is named when its whole name stands between word boundaries; the first such column in
    table order counts.
    """
    return _with_statistic(questions, columns).where(F.col("stat").isNotNull()).select(
        "dataset_id", "question_id", "stat.*")


def worst_missing_column(facts: DataFrame) -> DataFrame:
    """(dataset_id, column, null_percentage, null_count, row_count), first on ties."""
    best = F.max_by(
        F.struct("column", "null_percentage", "null_count", "row_count"),
        F.struct("null_percentage", -F.col("ordinal")))
    return facts.groupBy("dataset_id").agg(best.alias("w")).select("dataset_id", "w.*")


def strongest_pair(pairs: DataFrame) -> DataFrame:
    """(dataset_id, column_a, column_b, coefficient), first in table order on ties."""
    best = F.max_by(
        F.struct("column_a", "column_b", "coefficient"),
        F.struct(F.abs("coefficient"), -F.col("a"), -F.col("b")))
    return pairs.groupBy("dataset_id").agg(best.alias("s")).select("dataset_id", "s.*")


def route_questions(
    questions: DataFrame,
    profiles: DataFrame,
    columns: DataFrame,
    pairs: DataFrame,
    models: DataFrame | None = None,
) -> DataFrame:
    """(question_id, dataset_id, category, answer) for every question.

    Profile tables have one or few rows per dataset and are joined by ``dataset_id``.
    ``models`` is (dataset_id, model_name, metrics) with one result per dataset.
    """
    worst = worst_missing_column(columns).select("dataset_id", F.struct(
        F.col("column"), "null_percentage", "null_count", "row_count").alias("worst"))
    best = strongest_pair(pairs).select(
        "dataset_id", F.struct("column_a", "column_b", "coefficient").alias("best"))
    sizes = profiles.select("dataset_id", F.struct(
        "row_count", "duplicate_row_count", "duplicate_row_percentage").alias("size"))
    known = _with_statistic(questions, columns).join(sizes, "dataset_id", "left").join(worst, "dataset_id", "left") \
        .join(best, "dataset_id", "left")
    if models is None:
        known = known.withColumn(
            "model", F.lit(None).cast("struct<model_name:string,metrics:map<string,double>>"))
    else:
        known = known.join(models.select(
            "dataset_id", F.struct("model_name", "metrics").alias("model")),
            "dataset_id", "left")

    q = F.lower("question")
    size, top, pair, stat, model = (F.col(n) for n in ("size", "worst", "best", "stat", "model"))
    metrics = F.array_join(F.transform(
        F.array_sort(F.map_entries(model["metrics"])),
        lambda e: F.concat(e["key"], F.lit("="), shown(e["value"], 6))), ", ")
    lookup = F.lit(LOOKUP)
    none = F.lit(None).cast("string")
    unsupported = F.struct(F.lit(UNSUPPORTED).alias("category"), none.alias("answer"))

    def answered(text: Column) -> Column:
        return F.struct(lookup.alias("category"), text.alias("answer"))

    verdict = (
        F.when(size.isNull(), unsupported)
        .when(_has(q, "duplicate"), answered(F.format_string(
            "%d rows are copies of another, %.4f%% of %d rows.", size["duplicate_row_count"],
            size["duplicate_row_percentage"], size["row_count"])))
        .when(_has(q, "missing") & _has(q, *MOST_WORDS), F.when(
            top.isNull(), unsupported).otherwise(answered(F.format_string(
                "'%s' misses most: %.4f%%, %d of %d rows.", top["column"],
                top["null_percentage"], top["null_count"], top["row_count"]))))
        .when(_has(q, "correlat") & _has(q, *STRONG_WORDS), F.when(
            pair.isNull(), unsupported).otherwise(answered(F.format_string(
                "'%s' and '%s' correlate most: %.6f (Pearson).", pair["column_a"],
                pair["column_b"], pair["coefficient"]))))
        .when(stat.isNotNull(), answered(F.format_string(
            "The %s of '%s' is %.6f.", stat["statistic"], stat["column"], stat["value"])))
        .when(_has(q, *METRIC_WORDS), F.when(
            model.isNull(), unsupported).otherwise(answered(F.concat(
                F.lit("The model '"), model["model_name"], F.lit("' reported "), metrics,
                F.lit(".")))))
        .when(_has(q, "quality") & _has(q, *ISSUE_WORDS),
              F.struct(F.lit(EXPLANATION).alias("category"), none.alias("answer")))
        .otherwise(F.struct(F.lit(INTERPRETATION).alias("category"), none.alias("answer")))
    )
    return known.select("question_id", "dataset_id", verdict.alias("v")).select(
        "question_id", "dataset_id", "v.category", "v.answer")
