"""Inputs of the registered queries, as expressions both Spark and plain SQL understand.

The given tables have no gaps, so some inputs blank out or change values by rule. Every
input keeps all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Computed columns from which on the code of one row is too long for one method.
WIDE = 32


def _part(part: str, width: int = 2) -> str:
    return f"LPAD(CAST(EXTRACT({part} FROM o_orderdate) AS STRING), {width}, '0')"


YEAR, MONTH, DAY = _part("YEAR", 4), _part("MONTH"), _part("DAY")
SHORT_MONTH = ("SUBSTRING('JanFebMarAprMayJunJulAugSepOctNovDec', "
               "CAST(3 * EXTRACT(MONTH FROM o_orderdate) - 2 AS INT), 3)")
LONG_MONTH = "CASE EXTRACT(MONTH FROM o_orderdate) " + " ".join(
    f"WHEN {k} THEN '{m}'" for k, m in enumerate(
        "January February March April May June July August September October November "
        "December".split(), 1)) + " END"
# A day written in many ways; those from MONTHS_FROM on say only its month.
DATED = (
    "{y}/{m}/{d} 00:00", "{m}-{d}-{y} 00:00", "{d} {b} {y} 00:00", "{d}-{B}-{y}",
    "{y}.{m}.{d}", "{y}-{m}-{d} 12:00 AM", "{y}{m}{d}T000000", "{y}-{m}-{d}T05:30:00+0530",
    "Mon, {d} {b} {y} 00:00:00 +0000", "{B} {d} {y}",
    "   {m}/{d}/{y}                                 ", "{m}.{d}.{y} 00:00",
    "{m}/{d}/{y} 12:00 AM", "{b} {d}, {y} 00:00", "{y}-{m}-{d} 12:00:00.000 AM",
    "{y}{m}{d}T000000Z", "Tue, {B} {d}, {y}", "{m}-{d}-{y} 12:00:00am", "{y}-{m}", "{b} {y}",
)
MONTHS_FROM = 18


def _written(form: str) -> str:
    pieces = {"{y}": YEAR, "{m}": MONTH, "{d}": DAY, "{b}": SHORT_MONTH, "{B}": LONG_MONTH}
    for name, sql in pieces.items():
        form = form.replace(name, f"', {sql}, '")
    return f"CONCAT('{form}')"


INPUTS: dict[str, tuple[str, dict[str, str]]] = {
    # Dates as text in many layouts.
    "dated_orders": ("orders", {
        "o_orderkey": "o_orderkey",
        "o_orderdate": "o_orderdate",
        "written": f"CASE o_orderkey % {len(DATED)} " + " ".join(
            f"WHEN {k} THEN {_written(form)}" for k, form in enumerate(DATED)) + " END",
    }),
    # Measures with gaps, for statistics that skip missing values.
    "gappy_lineitem": ("lineitem", {
        "l_orderkey": "l_orderkey",
        "l_partkey": "l_partkey",
        "l_suppkey": "l_suppkey",
        "l_linenumber": "l_linenumber",
        "l_quantity": "CASE WHEN l_suppkey % 5 <> 0 THEN l_quantity END",
        "l_extendedprice": "l_extendedprice",
        "l_discount": "l_discount",
        "l_tax": "CASE WHEN l_partkey % 7 <> 0 THEN l_tax END",
        "l_returnflag": "CASE WHEN l_suppkey % 3 <> 0 THEN l_returnflag END",
        "l_linestatus": "l_linestatus",
        "l_shipdate": "CASE WHEN l_partkey % 4 <> 0 THEN l_shipdate END",
    }),
    # One column for every quality rule.
    "messy_orders": ("orders", {
        "o_orderkey": "o_orderkey",
        "total_amount": "CASE WHEN o_custkey % 9 <> 0 THEN o_totalprice END",
        "price": "CASE WHEN o_custkey % 50 = 0 THEN -o_totalprice ELSE o_totalprice END",
        "ratio": "CASE WHEN o_orderkey % 100 = 0 THEN CAST('Infinity' AS DOUBLE) "
                 "WHEN o_orderkey % 100 = 1 THEN CAST('-Infinity' AS DOUBLE) "
                 "WHEN o_orderkey % 100 = 2 THEN CAST('NaN' AS DOUBLE) "
                 "ELSE o_totalprice END",
        "order_day": "CASE WHEN o_orderkey % 20 = 7 THEN 'unknown' "
                     "ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END",
        "mixed": "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS STRING) "
                 "ELSE o_orderpriority END",
        "fixed": "'same'",
        "nearly": "CASE WHEN o_orderkey % 40 = 0 THEN 'b' ELSE 'a' END",
        "sparse": "CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus END",
        "code": "CAST(o_custkey AS STRING)",
        "voucher": "CONCAT('v', CAST(o_orderkey - o_orderkey % 5 "
                   "+ LEAST(o_orderkey % 5, 2) AS STRING))",
        "note": "CONCAT('note ', CAST(o_orderkey AS STRING))",
        "big": "o_totalprice > 250000.0",
        "o_orderdate": "o_orderdate",
    }),
    # Low-cardinality rows, so that whole rows repeat.
    "repeated_lines": ("lineitem", {
        "l_returnflag": "CASE WHEN l_suppkey % 3 <> 0 THEN l_returnflag END",
        "l_linestatus": "l_linestatus",
        "l_quantity": "l_quantity",
    }),
    # Every column as text, for type inference.
    "text_orders": ("orders", {
        "whole": "CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_custkey AS STRING) END",
        "number": "CASE WHEN o_orderkey % 10 = 0 THEN CAST(o_custkey AS STRING) "
                  "ELSE CONCAT(CAST(o_custkey AS STRING), '.5') END",
        "truth": "CASE WHEN o_totalprice > 250000.0 THEN 'True' ELSE 'False' END",
        "word": "o_orderstatus",
        "huge": "CONCAT(CAST(o_custkey + 1 AS STRING), '00000000000000000000000')",
        "blank": "CAST(NULL AS STRING)",
        "unsigned": "CONCAT('1', SUBSTRING(CAST(o_custkey + 1000000 AS STRING), 2, 6), "
                    "'0000000000000')",
    }),
    # A target and a copy of it among candidate features.
    "feature_orders": ("orders", {
        "o_orderkey": "o_orderkey",
        "status": "CASE WHEN o_custkey % 10 <> 0 THEN o_orderstatus END",
        "status_copy": "CASE WHEN o_custkey % 10 <> 0 THEN o_orderstatus END",
        "o_totalprice": "o_totalprice",
        "o_orderpriority": "o_orderpriority",
        "big": "o_totalprice > 250000.0",
        "clerk": "CONCAT('clerk ', CAST(o_custkey % 100 AS STRING))",
        "fixed": "1",
        "o_orderdate": "o_orderdate",
        "note": "CONCAT('note ', CAST(o_orderkey AS STRING))",
    }),
    # Targets that cannot be learned.
    "edge_orders": ("orders", {
        "o_orderkey": "o_orderkey",
        "void": "CAST(NULL AS STRING)",
        "few": "CASE WHEN o_orderkey < 7 THEN o_orderstatus END",
        "lone": "CASE WHEN o_orderkey = 7 THEN 'X' ELSE o_orderstatus END",
        "two": "CASE WHEN o_orderkey = 7 THEN 'X' ELSE 'Y' END",
    }),
    # Predictions by a fixed rule, so that their metrics need no model.
    "flag_predictions": ("lineitem", {
        "label": "l_linestatus",
        "prediction": "CASE WHEN l_quantity > 20.0 THEN 'O' ELSE 'F' END",
        "probability": "l_quantity / 50.0",
    }),
    "status_predictions": ("orders", {
        "label": "o_orderstatus",
        "prediction": "CASE WHEN o_totalprice > 300000.0 THEN 'O' "
                      "WHEN o_totalprice > 150000.0 THEN 'F' ELSE 'none' END",
    }),
    "price_predictions": ("lineitem", {
        "label": "l_extendedprice",
        "prediction": "l_quantity * 2000.0 + 2000.0",
    }),
    # Classes as whole numbers, predictions as doubles, as Spark's models give them.
    "number_predictions": ("lineitem", {
        "label": "CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS INT)",
        "prediction": "CAST(CASE WHEN l_quantity > 20.0 THEN 1 ELSE 0 END AS DOUBLE)",
    }),
    # Scores of which some are missing or no number.
    "odd_scores": ("lineitem", {
        "label": "l_linestatus",
        "probability": "CASE WHEN l_partkey % 50 = 0 THEN CAST('NaN' AS DOUBLE) "
                       "WHEN l_partkey % 50 = 1 THEN NULL ELSE l_quantity / 50.0 END",
    }),
    # A missing value in one column stands beside an outlier in another.
    "outlying": ("orders", {
        "near_one": "CASE WHEN o_orderkey % 1000 = 1 THEN NULL "
                    "ELSE 1.0 + CAST(o_orderkey AS DOUBLE) / 1000000000 END",
        "far": "CASE WHEN o_orderkey % 1000 = 1 THEN 1000000000.0 "
               "ELSE CAST(o_orderkey AS DOUBLE) END",
        "price": "o_totalprice",
    }),
    # More columns than a graph shows.
    "wide_lineitem": ("lineitem", {
        "l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber",
        **{f"c{k:02d}": f"CASE WHEN l_partkey % {k} <> 0 THEN l_quantity END"
           for k in range(2, 66)},
        "l_returnflag": "l_returnflag",
    }),
    # Files as a listing has them, with content that is text or not by rule.
    "uploads": ("documents", {
        "path": "CONCAT(source, '/', CAST(doc_id AS STRING))",
        "name": "CASE WHEN doc_id % 11 = 0 THEN '  ' WHEN doc_id % 5 = 1 THEN "
                "CONCAT(source, '.txt') WHEN doc_id % 5 = 2 THEN CONCAT(source, '.CSV') "
                "ELSE CONCAT(source, '.csv') END",
        "length": "CASE WHEN doc_id % 6 = 0 THEN CAST(0 AS BIGINT) "
                  "WHEN doc_id % 6 = 1 THEN n_chars * 100000 ELSE n_chars END",
        "text": "CASE WHEN doc_id % 7 = 1 THEN CONCAT(REPEAT(CHR(1), 2000), text) "
                "ELSE text END",
        "doc_id": "doc_id",
    }),
    # Questions: what a person wrote, followed by one of a few simple requests. Two datasets
    # share the ids of questions, and one dataset is unknown.
    "asked": ("conversations", {
        "question_id": "CONCAT(CAST(conv_id - conv_id % 2 AS STRING), '-', "
                       "CAST(turn AS STRING))",
        "dataset_id": "CASE WHEN conv_id % 17 = 16 THEN 'nowhere' "
                      "WHEN conv_id % 2 = 0 THEN 'orders' ELSE 'part' END",
        "question": "CONCAT(text, ' ', CASE (conv_id + turn) % 9 "
                    "WHEN 0 THEN 'How many duplicate rows are there?' "
                    "WHEN 1 THEN 'Which column has the most missing values?' "
                    "WHEN 2 THEN 'Which columns are strongly correlated?' "
                    "WHEN 3 THEN 'What is the average of total_amount?' "
                    "WHEN 4 THEN 'The median p_retailprice, please?' "
                    "WHEN 5 THEN 'What is the maximum o_orderstatus?' "
                    "WHEN 6 THEN 'How good is the accuracy?' "
                    "WHEN 7 THEN 'Are there data quality issues?' "
                    "ELSE 'Tell me more.' END)",
    }),
    "asked_orders": ("orders", {
        "o_orderkey": "o_orderkey",
        "o_custkey": "o_custkey",
        "total_amount": "CASE WHEN o_custkey % 9 <> 0 THEN o_totalprice END",
        "o_orderstatus": "o_orderstatus",
        "o_orderdate": "o_orderdate",
        "o_orderpriority": "o_orderpriority",
    }),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input, or the given table of that name."""
    if name not in INPUTS:
        return table(spark, sf_dir, name)
    base, columns = INPUTS[name]
    if len(columns) > WIDE:
        # A generated method above 8,000 bytes is never compiled by the JVM; without whole-stage
        # code Spark cuts the expressions of many columns into small methods.
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return table(spark, sf_dir, base).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def source_sql(name: str) -> str:
    """The same rows as a SQL subquery."""
    if name not in INPUTS:
        return f"(SELECT * FROM {name})"
    base, columns = INPUTS[name]
    return f"(SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {base})"
