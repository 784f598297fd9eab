"""One table and everything derived from it, sharing the few scans it takes."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, functions as F

from assayer.errors import AssayError
from assayer.operators import (
    correlation as C, distribution as D, facts as A, graph as G, profile as R, quality as Q,
    quantiles as L, targets as T,
)


class TableProfile:
    """Lazy profile tables of one DataFrame.

    ``facts`` has one row per column and feeds most of the others, so it is kept once
    computed; losing it only means computing it again.
    """

    def __init__(self, df: DataFrame, dataset_id: str, order_by: list[str] | None = None):
        self.df = df
        self.dataset_id = dataset_id
        self.order_by = order_by

    def _named(self, table: DataFrame) -> DataFrame:
        return table.withColumn("dataset_id", F.lit(self.dataset_id))

    @cached_property
    def facts(self) -> DataFrame:
        facts = A.column_facts(self.df).join(A.column_examples(self.df), "ordinal", "left")
        return self._named(facts).persist()

    @cached_property
    def dataset(self) -> DataFrame:
        return R.dataset_profile(self.df, self.dataset_id, self.facts).persist()

    @cached_property
    def columns(self) -> DataFrame:
        return R.column_profile(self.df, self.dataset_id, self.facts, self.order_by).persist()

    @cached_property
    def numeric(self) -> DataFrame:
        """``facts`` with ``numeric_stats``: what questions about columns look up."""
        names = [f.name for f in self.df.schema.fields if R.P.is_numeric(f.dataType)]
        ranked = R.with_quartiles(
            self.facts, L.quantiles(self.df, names).select("ordinal", "quantiles"))
        return ranked.withColumn("numeric_stats", F.when(
            F.col("semantic_type") == "numeric",
            F.struct("min", "max", "mean", "median", "std")))

    @cached_property
    def findings(self) -> DataFrame:
        return Q.quality_findings(self.dataset, self.facts).persist()

    @property
    def severities(self) -> DataFrame:
        return Q.severity_counts(self.findings)

    @cached_property
    def pairs(self) -> DataFrame:
        return self._named(C.correlation(self.df)).persist()

    @property
    def correlation_status(self) -> DataFrame:
        return self._named(C.correlation_status(self.df, self.pairs))

    @property
    def histogram(self) -> DataFrame:
        return self._named(D.histogram(self.df))

    @property
    def edges(self) -> DataFrame:
        return G.correlation_edges(self.pairs)

    @property
    def nodes(self) -> DataFrame:
        return G.feature_nodes(self.facts, self.findings)

    @property
    def all_nodes(self) -> DataFrame:
        """Every column, also those beyond what ``nodes`` shows."""
        return G.column_nodes(self.facts, self.findings)

    @property
    def suitability(self) -> DataFrame:
        return self._named(T.task_suitability(self.facts))

    def column(self, name: str) -> DataFrame:
        if name not in self.df.columns:
            raise AssayError("column_not_found", f"There is no column '{name}'.")
        return self.columns.where(F.col("column") == name)

    def close(self) -> None:
        """Release what was kept."""
        for name in ("facts", "dataset", "columns", "findings", "pairs"):
            if name in self.__dict__:
                self.__dict__[name].unpersist()


def together(profiles: list[TableProfile], name: str) -> DataFrame:
    """One profile table over many datasets."""
    return reduce(DataFrame.unionByName, (getattr(p, name) for p in profiles))
