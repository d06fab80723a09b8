"""The final dataset: raw matches and enriched folders in, six relations and a summary out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import JobConfig
from ..functions import scalars as S
from ..operators import relational as R
from ..schemas import FINAL_FIRST, KEYS, MATCHES_RAW, RAW_REQUIRED, TABLES
from ..sources.readers import arrived, read_batches, read_csv, typed
from ..sources.writers import summary, write_csv, write_text

POLICY = "CS2_from_first_LAN_cutoff"  # a fixed value
MERGED = ("match_date", "event_name", "team1", "team2", "source_url")


def raw_matches(raw: DataFrame, config: JobConfig) -> DataFrame:
    """Raw rows (as text, with arrival) from the cutoff on, the earliest of each match; the filter comes first."""
    rows = typed(R.normalize_text(R.expect_columns(raw, RAW_REQUIRED), [c for c in raw.columns if not c.startswith("__")], config.compat), MATCHES_RAW)
    rows = rows.filter(F.col("match_date") >= F.lit(config.cutoff_date))
    rows = R.keep_first(rows, ["match_id"], [F.col("match_date"), F.col(R.ROW)]).drop(R.BATCH, R.ROW)
    return rows.withColumns({"game_version_policy": F.lit(POLICY), "game_version_cutoff_date": F.lit(config.cutoff_date.isoformat())})


def dedupe(name: str, rows: DataFrame, compat: bool = False) -> DataFrame:
    """The last row of each key of table ``name``.

    Enriched matches go by datetime, then folder, then arrival. A missing datetime is the oldest; with ``compat``
    it is the newest, as earlier tools had it. Other tables go by arrival alone.
    """
    if name == "matches_enriched" and "match_datetime_utc" in rows.columns:
        when = F.desc_nulls_first("match_datetime_utc") if compat else F.desc_nulls_last("match_datetime_utc")
        rows = R.keep_last(rows, KEYS[name], [when, F.desc_nulls_first("source_dir"), F.desc(R.BATCH), F.desc(R.ROW)])
    else:
        rows = R.keep_last_arrival(rows, KEYS[name])
    return rows.drop(R.BATCH, R.ROW, "source_dir")


def merge(raw: DataFrame, enriched: DataFrame, compat: bool = False) -> DataFrame:
    """One row per raw match, with what enrichment knows; ordered columns, sorted by date and id (as text).

    Without any enriched row of these matches the raw rows are the result as they are.
    """
    if enriched.isEmpty():
        return raw.orderBy(F.asc_nulls_last("match_date"), F.asc_nulls_last("match_id"))
    out = R.coalesce_join(raw, enriched, "match_id", MERGED, compat=compat)
    if not compat and "event_id_raw" in out.columns:
        out = out.withColumn("event_id", S.first_nonempty(F.col("event_id_enriched"), F.col("event_id_raw")))
    return R.reorder(out, FINAL_FIRST).orderBy(F.asc_nulls_last("match_date"), F.asc_nulls_last("match_id"))


def build(clean: DataFrame, tables: dict[str, DataFrame], config: JobConfig) -> dict[str, DataFrame]:
    """All output relations as plans. The semi-join comes before each dedupe, which it commutes with.

    Only whether there is an enriched match is found at once, by a job that ends at the first row.
    """
    ids = clean.select("match_id")
    kept = {n: dedupe(n, R.semi_filter(df, ids, "match_id"), config.compat) for n, df in tables.items()}
    final = merge(clean, kept.pop("matches_enriched"), config.compat)
    dates = final.select("match_id", "match_date")
    for n in ("match_maps", "map_player_stats"):
        kept[n] = R.backfill(kept[n], dates, "match_id", "match_date")
    return {"matches_raw_clean": clean, "matches_final": final, **kept}


def run(spark: SparkSession, config: JobConfig) -> str:
    """Read, build, write CSV folders and the summary; returns the summary. Rows are counted as they are written."""
    raw = arrived(read_csv(spark, config.raw_path, MATCHES_RAW, compat=config.compat))
    tables = {n: read_batches(spark, config.enriched_dirs, n, schema, config.compat) for n, schema in TABLES.items()}
    # the clean raw matches are what every table is filtered by, and the final ones what dates are looked up in
    clean = raw_matches(raw, config).persist()
    try:
        out = build(clean, tables, config)
        final = out["matches_final"].persist()
        try:
            seen = {n: write_csv(final if n == "matches_final" else df, f"{config.output_dir}/{n}.csv") for n, df in out.items()}
        finally:
            final.unpersist()
        text = summary(config.cutoff_date, seen)
        write_text(spark, text, f"{config.output_dir}/README_summary.txt")
        return text
    finally:
        clean.unpersist()
