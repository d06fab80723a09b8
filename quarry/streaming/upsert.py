"""Keep-last as a stream: files that arrive update a keyed table. An extension beside the batch plans."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import keep_last


def upsert(current: DataFrame | None, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """current with the rows of batch, the last of each key; at equal order the batch wins."""
    fresh = batch.withColumn("__new", F.lit(1))
    rows = fresh if current is None else current.withColumn("__new", F.lit(0)).unionByName(fresh, allowMissingColumns=True)
    return keep_last(rows, keys, [*order, "__new"]).drop("__new")


def start(spark: SparkSession, source: str, schema: T.StructType, target: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """A file-source stream whose micro-batches go to ``target(frame, epoch)``, which has to be idempotent."""
    stream = spark.readStream.schema(schema).parquet(source)
    writer = stream.writeStream.foreachBatch(target).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
