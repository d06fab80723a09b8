"""Lineage that is cut: tables written once to the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where driver and executors are one process."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="checkpoint-")


def settled(df: DataFrame) -> DataFrame:
    """The rows of df written once to the shared folder, read back without their lineage.

    A lost executor then costs a reread of files, not the steps before. Spark removes the files of frames that are
    gone if the session has ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
