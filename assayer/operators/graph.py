"""The column graph: columns as nodes, strong correlations as edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.operators.correlation import strongest_pairs

# Fixed caps.
PROFILE_NODES = 60
EDGES = 30
SEARCH_RESULTS = 8


def _flags(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("column").isNotNull()).groupBy("dataset_id", "column").agg(
        F.bool_or(F.col("severity") == "warning").alias("has_warning"),
        F.bool_or(F.col("severity") == "critical").alias("has_critical"))


def _node(*extra: str | Column) -> list:
    critical = F.coalesce("has_critical", F.lit(False))
    return [
        "dataset_id", *extra, "column",
        F.coalesce("semantic_type", F.lit("unknown")).alias("semantic_type"),
        F.coalesce("null_percentage", F.lit(0.0)).alias("null_percentage"),
        F.coalesce("has_warning", F.lit(False)).alias("has_warning"),
        critical.alias("has_critical"),
        F.when(critical, "error").otherwise("idle").alias("state"),
    ]


def column_nodes(facts: DataFrame, findings: DataFrame) -> DataFrame:
    """All columns of each dataset with their quality flags: what search and filters read."""
    return facts.join(_flags(findings), ["dataset_id", "column"], "left") \
        .select(*_node("ordinal"))


def feature_nodes(facts: DataFrame, findings: DataFrame, limit: int = PROFILE_NODES) -> DataFrame:
    """The first columns of each dataset with their quality flags: what a graph shows."""
    first = Window.partitionBy("dataset_id").orderBy("ordinal")
    shown = facts.withColumn("place", F.row_number().over(first)).where(F.col("place") <= limit)
    return column_nodes(shown, findings)


def correlation_edges(pairs: DataFrame, limit: int = EDGES) -> DataFrame:
    """The strongest pairs of each dataset, by rank."""
    return strongest_pairs(pairs, limit, by=["dataset_id"]).select(
        "dataset_id", F.col("rank").cast("int").alias("rank"),
        F.col("column_a").alias("source"), F.col("column_b").alias("target"),
        "coefficient", "observations")


def correlated_columns(edges: DataFrame) -> DataFrame:
    """(dataset_id, column, first_touch): columns in the order edges first touch them."""
    ends = edges.select(
        "dataset_id", "rank", F.posexplode(F.array("source", "target")).alias("side", "column"))
    return ends.groupBy("dataset_id", "column").agg(
        F.min(F.col("rank") * 2 + F.col("side") - 1).alias("first_touch"))


def analytics_nodes(edges: DataFrame, facts: DataFrame, findings: DataFrame) -> DataFrame:
    """Touched columns with their profile; defaults where there is none."""
    known = facts.select("dataset_id", "column", "semantic_type", "null_percentage")
    return (
        correlated_columns(edges)
        .join(known, ["dataset_id", "column"], "left")
        .join(_flags(findings), ["dataset_id", "column"], "left")
        .select(*_node("first_touch"))
    )


def column_search(nodes: DataFrame, query: str, limit: int = SEARCH_RESULTS) -> DataFrame:
    """Columns whose name contains the query, first in table order; none for a blank."""
    wanted = query.strip().lower()
    if not wanted:
        return nodes.limit(0)
    first = Window.partitionBy("dataset_id").orderBy("ordinal")
    return (
        nodes.where(F.contains(F.lower("column"), F.lit(wanted)))
        .withColumn("place", F.row_number().over(first)).where(F.col("place") <= limit)
        .drop("place")
    )


def column_filter(
    nodes: DataFrame,
    numeric: bool = False,
    categorical: bool = False,
    missing: bool = False,
    quality: bool = False,
    correlated: DataFrame | None = None,
    model_columns: DataFrame | None = None,
    query: str = "",
) -> DataFrame:
    """Columns that meet any chosen facet, and the query; no facet means all.

    ``correlated`` and ``model_columns`` are tables of (dataset_id, column).
    """
    wanted = query.strip().lower()
    if wanted:
        nodes = nodes.where(F.contains(F.lower("column"), F.lit(wanted)))
    chosen = []
    if numeric:
        chosen.append(F.col("semantic_type") == "numeric")
    if categorical:
        chosen.append(F.col("semantic_type") == "categorical")
    if missing:
        chosen.append(F.col("null_percentage") > 0)
    if quality:
        chosen.append(F.col("has_warning") | F.col("has_critical"))
    columns = nodes.columns
    for name, table in (("_correlated", correlated), ("_modelled", model_columns)):
        if table is not None:
            marks = table.select("dataset_id", "column").distinct().withColumn(name, F.lit(True))
            nodes = nodes.join(marks, ["dataset_id", "column"], "left")
            chosen.append(F.coalesce(name, F.lit(False)))
    if chosen:
        any_of = chosen[0]
        for facet in chosen[1:]:
            any_of = any_of | facet
        nodes = nodes.where(any_of)
    return nodes.select(*columns)
