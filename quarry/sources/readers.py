"""Sources: CSV tables with a declared schema, tables in several folders, saved pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..operators.relational import BATCH, ROW, normalize_text, union_by_name
from ..schemas import as_text

#: Text that a CSV of earlier tools used for a missing value, besides the empty text.
NA_TOKENS = ("NA", "N/A", "n/a", "NaN", "nan", "NULL", "null", "None", "<NA>", "#N/A", "#NA", "-nan", "-NaN", "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN")
_IDS = ("match_id", "event_id", "team_id", "team1_id", "team2_id", "team_left_id", "team_right_id", "player_id", "mapstatsid")


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns to their types, leniently: what cannot be read is null. Columns of no known type stay text."""
    kinds = {f.name: f.dataType for f in schema}
    out = []
    for c in df.columns:
        col, kind = F.col(c), kinds.get(c)
        if c in _IDS:
            col = S.canonical_id(col)
        elif isinstance(kind, (T.LongType, T.IntegerType)):
            col = S.safe_int(F.regexp_replace(col, r"\.0$", "")).cast(kind)
        elif isinstance(kind, T.DoubleType):
            col = S.safe_float(col)
        elif isinstance(kind, T.BooleanType):
            col = F.lower(F.trim(col)).try_cast("boolean")
        elif isinstance(kind, T.DateType):
            col = S.lenient_timestamp(col).cast("date")
        elif isinstance(kind, T.TimestampType):
            col = col.try_cast("timestamp")
        out.append(col.alias(c))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, required: bool = True, compat: bool = False, multiline: bool = False) -> DataFrame | None:
    """A CSV with a header, all columns as text, empty as null. A missing file is an error, or None if not required.

    Columns are found by their names in the header; those of the schema that the file lacks are left out. A large file
    is read by many tasks. Only files whose quoted cells hold line breaks need ``multiline``, one task a file; none of
    the library's own do, as its text is normalised.
    """
    try:
        df = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"').option("inferSchema", False).csv(path)
    except AnalysisException as e:
        if required or "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    if not df.columns:  # a file without even a header
        return spark.createDataFrame([], as_text(schema)) if schema is not None else df
    if compat:
        df = df.select(*[F.when(~F.col(c).isin(*NA_TOKENS), F.col(c)).alias(c) for c in df.columns])
    return df


#: The place of a row in its table: file, where its part of the file begins, and its number in that part.
PLACE = T.StructType([T.StructField("file", T.StringType()), T.StructField("part", T.LongType()), T.StructField("row", T.LongType())])


def arrived(df: DataFrame, batch: int = 0) -> DataFrame:
    """df with its batch and a place that follows the order of files and of the lines in each.

    Has to come right after the scan. Within a part of a file rows are numbered as they are read, and parts by where
    they begin, so the order holds whatever tasks the parts are dealt to.
    """
    number = F.monotonically_increasing_id().alias("row")
    try:
        place = df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), number).alias(ROW))
        place.schema  # noqa: B018  only a scan has the metadata
    except AnalysisException:
        place = df.withColumn(ROW, F.struct(F.lit("").alias("file"), F.lit(0).cast("bigint").alias("part"), number))
    return place.withColumn(BATCH, F.lit(batch))


def read_batches(spark: SparkSession, folders: Sequence[str], name: str, schema: T.StructType, compat: bool = False, multiline: bool = False) -> DataFrame:
    """The table ``name``.csv of all folders that have it, later folders as later batches, with source_dir.

    Without any file an empty frame with the schema. Text is normalised, then typed.
    """
    found = []
    for k, folder in enumerate(folders):
        df = read_csv(spark, f"{folder.rstrip('/')}/{name}.csv", schema, required=False, compat=compat, multiline=multiline)
        if df is not None:
            found.append(arrived(df, k).withColumn("source_dir", F.lit(folder.rstrip("/").rsplit("/", 1)[-1])))
    if not found:
        empty = T.StructType([*schema, T.StructField(BATCH, T.IntegerType()), T.StructField(ROW, PLACE), T.StructField("source_dir", T.StringType())])
        return spark.createDataFrame([], empty)
    rows = union_by_name(found)
    text = [c for c in rows.columns if c not in (BATCH, ROW, "source_dir")]
    return typed(normalize_text(rows, text, compat=compat), schema)


#: Parts of pages that a site shows in place of its content.
CHALLENGE_MARKS = ("challenge-error-title", "enable javascript and cookies to continue")
#: Whole titles of such pages; the same words elsewhere are content.
CHALLENGE_TITLE = r"<title[^>]*>\s*(just a moment[.\u2026]*|attention required![^<]*cloudflare)\s*</title>"


def read_pages(spark: SparkSession, path: str, key_regex: str, key: str = "page_key") -> tuple[DataFrame, DataFrame]:
    """(pages, refused) of a folder of saved HTML files: (key, path, html), the key by a regex on the file's name."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))
    rows = files.select(S.first_text(F.col("path"), key_regex).alias(key), "path", "html")
    low = F.lower("html")
    refused = low.rlike(CHALLENGE_TITLE)
    for mark in CHALLENGE_MARKS:
        refused = refused | low.contains(mark)
    return rows.filter(~refused & F.col(key).isNotNull()), rows.filter(refused | F.col(key).isNull())
