"""Session helpers of the llm operators: input tables, cut lineage, batches of texts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import settled, shared_folder

__all__ = ["partitions", "settled", "settled_texts", "shared_folder", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


BATCH_BYTES = 4 << 20
_OPTION = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_OPTION)
    spark.conf.set(_OPTION, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_OPTION, before)


def settled_texts(df: DataFrame) -> DataFrame:
    """settled(), with Arrow batches of about BATCH_BYTES while it runs, as its tasks hold much beside their batch of texts."""
    with _small_batches(df.sparkSession):
        return settled(df)
