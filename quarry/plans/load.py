"""Raw matches from saved results pages, and the cleaner of generic match lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import JobConfig
from ..functions import scalars as S
from ..operators import extract
from ..operators import relational as R
from ..schemas import MATCHES_RAW
from ..session import settled


def load(pages: DataFrame, config: JobConfig, key: str = "page_idx") -> dict[str, DataFrame]:
    """matches_raw, pages and errors from pages (key, html) in page order.

    Pages count up to the first that has no dated entry or whose oldest date is before the start, that one
    included; ``max_pages`` at most. A page that cannot be read has no dated entry, and is in the errors (kind, key,
    error). Of a match the first valid entry stays. ``pages`` are those that count: (key, newest, oldest). An error if no
    valid match is left. Every page is parsed once: what was parsed is written before it is read three times.
    """
    config.checked()
    results = settled(extract.results_pages(pages.filter(F.col(key) < config.max_pages), key))
    rows = extract.result_rows(results, key)
    dates = results.select(key).join(extract.page_dates(rows, key), key, "left")
    used = R.until_stop(dates, key, F.col("oldest").isNull() | (F.col("oldest") < F.lit(config.start_date)))
    valid = R.valid_matches(rows.join(used.select(key), key, "left_semi"), config.start_date, config.end_date)
    first = R.keep_first(valid, ["match_id"], [F.col(key), F.col("ordinal")])
    fixed = {
        "game": F.lit("CS2"), "completed": F.lit(True), "is_professional_proxy": F.lit(True), "professional_filter_note": F.lit("regular results listing"), "source": F.lit("results pages"),
    }
    matches = first.withColumns(fixed).select(*MATCHES_RAW.names)
    if matches.isEmpty():
        raise ValueError("no valid match in the pages")
    failed = extract.errors(results.join(used.select(key), key, "left_semi"), key, "results")
    return {"matches_raw": matches.orderBy("match_date", "event_name", "match_id"), "pages": used, "errors": failed}


def progress(pages: DataFrame, config: JobConfig, minutes: float | None = None, key: str = "page_idx") -> DataFrame:
    """(pages, covered_days, total_days, percent, pages_per_min, eta_min) of the ``pages`` of a load, after so many minutes.

    The days covered are those from the oldest date of the last page to the end; without dates they, the share and
    what is to come are null, as is the time to come while nothing is covered.
    """
    total = max(1, (config.end_date - config.start_date).days)
    last = pages.agg(F.count("*").alias("pages"), F.max_by("oldest", key).alias("oldest"))
    covered = F.when(F.col("oldest").isNotNull(), S.clamped(F.datediff(F.lit(config.end_date), "oldest").cast("bigint"), F.lit(0).cast("bigint"), F.lit(total).cast("bigint")))
    took = F.lit(minutes).cast("double")
    out = last.select("pages", covered.alias("covered_days"), F.lit(total).cast("bigint").alias("total_days")).withColumn("percent", 100.0 * F.col("covered_days") / total)
    speed = F.when(took > 0, F.col("pages") / took).otherwise(F.lit(0.0))
    return out.withColumns({"pages_per_min": speed, "eta_min": F.when(F.col("percent") > 0, F.greatest(F.lit(0.0), took / (F.col("percent") / 100.0) - took))})


def clean(matches: DataFrame) -> DataFrame:
    """Clean names, distinct rows, then dates: two spellings of a date stay two rows."""
    rows = R.clean_names(matches).distinct()
    return rows.withColumn("match_date", S.lenient_timestamp(F.col("match_date"))) if "match_date" in rows.columns else rows


def preview(df: DataFrame, n: int = 10) -> tuple[DataFrame, int, int]:
    """(first rows, number of rows, number of columns)."""
    return df.limit(n), df.count(), len(df.columns)
