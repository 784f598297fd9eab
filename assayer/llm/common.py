"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayer.session import scratch_path

# ASCII letters in lower case; every ASCII character that is no letter or
# digit ends a word. Bytes of longer UTF-8 characters always belong to words.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words of a text as UTF-8; NULL has none."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


class Recent:
    """A memory of about ``limit`` to twice as many entries. When the young generation is
    full it becomes the old one, and what is asked for again moves back, so that frequent
    keys stay while rare ones go."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.young: dict = {}
        self.old: dict = {}

    def found(self, keys: list) -> list:
        """The values of keys, None where there is none."""
        young, old = self.young, self.old
        values = list(map(young.get, keys))
        if old and None in values:
            for k in [k for k, value in enumerate(values) if value is None]:
                value = old.get(keys[k])
                if value is not None:
                    values[k] = young[keys[k]] = value
        return values

    def keep(self, key, value) -> None:
        if len(self.young) >= self.limit:
            self.young, self.old = {}, self.young
        self.young[key] = value


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared scratch folder and read again: cuts the lineage, survives the
    loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[
        tuple[pa.RecordBatch, list[str | None]]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column(batch.schema.get_field_index(column)).to_pylist()


def text_hash(column: Column) -> Column:
    """Tells rows of equal ids apart; NULL and empty text differ."""
    return F.when(column.isNull(), F.lit(0)).otherwise(F.xxhash64(column))
