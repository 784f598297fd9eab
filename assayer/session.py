"""Session settings the engine relies on, and its shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from assayer.errors import AssayError

SCRATCH_SETTING = "spark.checkpoint.dir"


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings every session should have.

    UTC keeps time values comparable across machines. Adaptive execution sizes the
    shuffles, splits skewed partitions and turns joins with tiny profile tables into
    broadcasts.
    """
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder shared by all executors, which the cluster names in
    ``spark.checkpoint.dir``."""
    base = spark.conf.get(SCRATCH_SETTING, None)
    if not base:
        raise AssayError("no_scratch_folder",
                         f"Set {SCRATCH_SETTING} to a folder that all executors share.")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
