"""Fixed sentences over evidence. Pure projections: no number is computed here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.text import shown, timestamp_text

# Fixed caps of what a text may list.
FINDINGS_TOLD = 10
PAIRS_TOLD = 5

UNSUPPORTED = "The evidence at hand holds nothing on this question."
NOT_ENOUGH = "The evidence at hand does not settle this question."


def _fact(*parts) -> Column:
    return F.concat(F.lit("FACT: "), *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _reading(text: str) -> Column:
    return F.lit("INTERPRETATION: " + text)


def _text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def narrate_summary(evidence: DataFrame) -> DataFrame:
    """(dataset_id, narration) from ``evidence_summary``."""
    found = F.col("quality_finding_count")
    sentences = F.concat_ws(
        " ",
        _fact(_text("row_count"), " rows and ", _text("column_count"), " columns."),
        _fact(shown(F.col("missing_percentage")), "% of the cells are empty and ",
              shown(F.col("duplicate_row_percentage")), "% of the rows are copies."),
        F.when(found == 0, _fact("no quality finding.")).otherwise(_fact(
            _text(found), " quality findings: ", _text("critical_count"), " critical, ",
            _text("warning_count"), " warnings, ", _text("info_count"), " notes.")),
        _reading("what the table is about is not part of this evidence."),
    )
    return evidence.select("dataset_id", sentences.alias("narration"))


def narrate_quality(evidence: DataFrame) -> DataFrame:
    """(dataset_id, narration) from ``evidence_quality``; at most ten findings told."""
    where = F.coalesce(F.concat(F.lit(" on '"), F.col("column"), F.lit("'")), F.lit(""))
    line = F.concat(F.lit("FACT ("), F.col("severity"), F.lit(")"), where, F.lit(": "),
                    F.col("message"))
    return (
        evidence.where(F.col("place").isNull() | (F.col("place") <= FINDINGS_TOLD))
        .groupBy("dataset_id", "finding_count")
        .agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
        .select("dataset_id", F.when(
            F.col("finding_count") == 0, F.concat_ws(
                " ", _fact("no quality finding."),
                _reading("no rule was broken; that does not make the values right.")))
        .otherwise(F.concat_ws(
            " ", _fact(_text("finding_count"), " quality findings."),
            F.array_join(F.transform("lines", lambda x: x["line"]), " "),
            _reading("whether they matter depends on the use of the table."),
        )).alias("narration"))
    )


def narrate_column(evidence: DataFrame) -> DataFrame:
    """(dataset_id, column, narration) from ``evidence_column`` or whole profiles."""
    n, k, t = (F.col(f"{b}_stats") for b in ("numeric", "categorical", "datetime"))
    top = F.try_element_at(k["top_values"], F.lit(1))

    def number(name: str) -> Column:
        return F.coalesce(shown(n[name]), F.lit("none"))

    return evidence.select("dataset_id", "column", F.concat_ws(
        " ",
        _fact("'", F.col("column"), "' is stored as ", F.col("raw_type"), " and reads as ",
              F.col("semantic_type"), "."),
        _fact(shown(F.col("null_percentage")), "% of its values are missing; ",
              shown(F.col("unique_percentage")), "% of the others are different."),
        F.when(n.isNotNull(), _fact(
            "least ", number("min"), ", greatest ", number("max"), ", mean ", number("mean"),
            ", median ", number("median"), ", deviation ", number("std"), ".")),
        F.when(top.isNotNull(), _fact(
            "'", top["value"], "' is most frequent, in ", shown(top["percentage"]),
            "% of the rows, among ", _text(k["cardinality"]), " values.")),
        F.when(t["min_date"].isNotNull(), _fact(
            "from ", timestamp_text(t["min_date"]), " to ", timestamp_text(t["max_date"]), ".")),
        F.concat(F.lit("INTERPRETATION: the name '"), F.col("column"),
                 F.lit("' alone does not tell what the values mean.")),
    ).alias("narration"))


def narrate_correlation(evidence: DataFrame, status: DataFrame) -> DataFrame:
    """(dataset_id, narration); ``status`` has one row per dataset."""
    line = F.concat(
        F.lit("FACT: '"), F.col("column_a"), F.lit("' and '"), F.col("column_b"),
        F.lit("' have a coefficient of "), shown(F.col("coefficient"), 6), F.lit(" over "),
        _text("observations"), F.lit(" rows, a "), F.col("strength"), F.lit(" association."))
    told = evidence.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("listed"),
        F.array_sort(F.collect_list(F.when(F.col("rank") <= PAIRS_TOLD, F.struct(
            F.col("rank"), line.alias("line"))))).alias("lines"))
    return status.join(told, "dataset_id", "left").select("dataset_id", F.when(
        F.col("status") == "insufficient_data", _fact(F.col("message"))
    ).otherwise(F.concat_ws(
        " ", _fact("Pearson's coefficient, ", _text("listed"), " column pairs."),
        F.array_join(F.transform("lines", lambda x: x["line"]), " "),
        _reading("an association in the numbers says nothing about causes."),
    )).alias("narration"))


def narrate_model(evidence: DataFrame) -> DataFrame:
    """Evidence columns that are no result fields, and the narration of each result."""
    def listed(name: str, middle: str) -> Column:
        entries = F.array_sort(F.map_entries(F.col(name)))
        number = name == "metrics"
        return F.transform(entries, lambda e: F.concat(
            F.lit("FACT: "), e["key"], F.lit(middle),
            shown(e["value"], 6) if number else e["value"], F.lit(".")))

    def told(name: str, middle: str) -> Column:
        return F.when(F.size(F.coalesce(name, F.create_map())) > 0,
                      F.array_join(listed(name, middle), " "))

    none = F.array().cast("array<string>")
    sentences = F.concat_ws(
        " ",
        _fact("'", F.col("model_name"), "' learned '", F.col("target_column"), "' (",
              F.col("task_type"), ") from ", _text(F.size("feature_columns")),
              " columns, with ", _text("train_size"), " training and ",
              _text("test_size_actual"), " test rows."),
        told("metrics", " is "), told("unavailable_metrics", " was not computed: "),
        F.when(F.size(F.coalesce("warnings", none)) > 0,
               _fact("warnings: ", F.array_join("warnings", "; "))),
        _reading("these are baseline numbers, no verdict on the model."),
    )
    ids = [c for c in evidence.columns if c in ("dataset_id", "result_id")]
    return evidence.where(F.col("error").isNull()).select(*ids, sentences.alias("narration"))


def narrate_answer(routed: DataFrame) -> DataFrame:
    """(question_id, narration) from routed questions: the answer, or why there is none."""
    return routed.select(
        "question_id", F.when(F.col("category") == "unsupported", F.lit(UNSUPPORTED))
        .when(F.col("answer").isNotNull(), _fact(F.col("answer")))
        .otherwise(F.lit(NOT_ENOUGH)).alias("narration"))
