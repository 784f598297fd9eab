"""Registered datasets: parquet data and one catalog row each."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.utils import AnalysisException

from assayer.errors import AssayError
from assayer.operators.profile import structural_facts

VALID_ID = re.compile(r"^[A-Za-z0-9_-]+$")

ROW = (
    "id string, original_filename string, uploaded_at timestamp, size_bytes bigint, "
    "row_count bigint, column_count int, columns array<struct<name:string,dtype:string>>, "
    "missing_value_count bigint, duplicate_row_count bigint, schema_json string"
)
SUMMARY = ("id", "original_filename", "uploaded_at", "size_bytes", "row_count", "column_count")


class Catalog:
    """Datasets below one root folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _data_path(self, dataset_id: str) -> str:
        if not VALID_ID.match(dataset_id or ""):
            raise AssayError("dataset_not_found", f"'{dataset_id}' is no dataset id.")
        return f"{self.root}/data/{dataset_id}"

    def register(
        self,
        df: DataFrame,
        filename: str,
        dataset_id: str | None = None,
        size_bytes: int | None = None,
    ) -> str:
        """Store the data, then its catalog row; a failed write leaves no row behind."""
        dataset_id = dataset_id or str(uuid.uuid4())
        path = self._data_path(dataset_id)
        df.write.mode("error").parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        if size_bytes is None:
            size_bytes = (
                self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
                .load(path).agg(F.sum("length")).first()[0] or 0)
        columns = F.array(*[
            F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("dtype"))
            for f in df.schema.fields
        ]).cast("array<struct<name:string,dtype:string>>")
        structural_facts(stored).select(
            F.lit(dataset_id).alias("id"), F.lit(filename).alias("original_filename"),
            F.current_timestamp().alias("uploaded_at"),
            F.lit(size_bytes).cast("bigint").alias("size_bytes"), "row_count",
            "column_count", columns.alias("columns"), "missing_value_count",
            "duplicate_row_count", F.lit(df.schema.json()).alias("schema_json"),
        ).coalesce(1).write.mode("append").parquet(f"{self.root}/catalog")
        return dataset_id

    def entries(self) -> DataFrame:
        """All catalog rows."""
        try:
            return self.spark.read.schema(ROW).parquet(f"{self.root}/catalog")
        except AnalysisException:
            return self.spark.createDataFrame([], ROW)

    def list(self) -> DataFrame:
        """Summaries without column detail, by id."""
        return self.entries().select(*SUMMARY).orderBy("id")

    def get(self, dataset_id: str) -> DataFrame:
        """The catalog row of one dataset; a filter that reaches the scan."""
        self._data_path(dataset_id)
        return self.entries().where(F.col("id") == dataset_id)

    def load(self, dataset_id: str) -> DataFrame:
        """Reopen a dataset under the schema stored with it."""
        row = self.get(dataset_id).first()
        if row is None:
            raise AssayError("dataset_not_found", f"There is no dataset '{dataset_id}'.")
        schema = T.StructType.fromJson(json.loads(row["schema_json"]))
        try:
            return self.spark.read.schema(schema).parquet(self._data_path(dataset_id))
        except AnalysisException as broken:
            raise AssayError("dataset_unreadable",
                             f"The data of '{dataset_id}' cannot be read.") from broken
