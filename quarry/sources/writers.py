"""Sinks: CSV folders with a header, Parquet between stages, a text summary."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, single: bool = False) -> dict:
    """Overwrite a folder of CSV files; ``single`` makes one file, for small exports only.

    Returns what was written, counted on the way: rows and, of a table with match_date, its first and last date.
    """
    seen, found = Observation(), [F.count(F.lit(1)).alias("rows")]
    if "match_date" in df.columns:
        found += [F.min("match_date").alias("first"), F.max("match_date").alias("last")]
    df = df.observe(seen, *found)
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ssXXX").option("emptyValue", "").csv(path)
    return seen.get


def write_parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def summary(cutoff: date, written: dict[str, dict]) -> str:
    """Rows of the relations as ``write_csv`` counted them, the cutoff and the range of dates of the final table."""
    lines = ["Summary", f"cutoff date: {cutoff}", *[f"{n}: {seen['rows']} rows" for n, seen in written.items()]]
    final = written.get("matches_final", {})
    if final.get("first") is not None:
        lines.append(f"match dates: {final['first']} to {final['last']}")
    return "\n".join([*lines, "files: " + ", ".join(f"{n}.csv" for n in written)]) + "\n"


def write_text(df_or_session, text: str, path: str) -> None:
    """One text file in a folder, by Spark, so any file system that it knows will do."""
    spark = getattr(df_or_session, "sparkSession", df_or_session)
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)
