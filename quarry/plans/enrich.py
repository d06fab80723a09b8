"""Enriched relations from saved match pages and map statistics pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import JobConfig
from ..functions import scalars as S
from ..operators import extract
from ..operators import relational as R
from ..session import settled


def chosen(raw: DataFrame, config: JobConfig) -> DataFrame:
    """The matches to enrich: in order of date and id (as text), after the offset, up to the limit."""
    return R.page_slice(raw, [F.asc_nulls_last("match_date"), F.asc_nulls_last("match_id")], config.start_offset, config.limit_matches)


def stats_address(maps: DataFrame, base_url: str = extract.BASE_URL) -> DataFrame:
    """Maps that have a statistics page, with its address."""
    known = maps.filter(F.col("mapstatsid").isNotNull() & (F.col("mapstatsid") != "0"))
    fallback = F.concat(F.lit(base_url + "/stats/matches/mapstatsid/"), F.col("mapstatsid"), F.lit("/x"))
    return known.select("match_id", "map_no", "mapstatsid", S.absolute_url(F.col("stats_href"), base_url, fallback).alias("address"))


def enrich(raw: DataFrame, match_pages: DataFrame, stats_pages: DataFrame, config: JobConfig) -> dict[str, DataFrame]:
    """Five relations and the errors. match_pages: (match_id, html); stats_pages: (mapstatsid, html).

    Every page is parsed once, to a row of arrays that is written and then read by all relations. A page that cannot
    be read costs its own rows only, and it is in ``errors`` (kind, key, error), like a chosen match without a saved
    page. Maps without a statistics page keep nulls there.
    """
    todo = settled(chosen(raw, config))
    matches = settled(extract.match_pages(match_pages.join(todo.select("match_id").distinct(), "match_id", "left_semi")))
    lineups = extract.match_lineups(matches)
    vetoes = extract.veto_steps(matches)
    maps = extract.match_maps(matches, vetoes)
    wanted = stats_address(maps).select("mapstatsid").distinct()
    stats = settled(extract.stats_pages(stats_pages.join(wanted, "mapstatsid", "left_semi")))
    players = extract.player_stats(stats).join(maps.select("match_id", "map_no", "mapstatsid"), "mapstatsid")
    meta = extract.match_meta(matches, todo).join(extract.rosters(lineups), "match_id", "left")
    hashes = {c: F.coalesce(c, F.lit("")) for c in ("team1_roster_hash", "team2_roster_hash")}
    missing = todo.select("match_id").distinct().join(matches, "match_id", "left_anti").select(F.lit("match").alias("kind"), F.col("match_id").cast("string").alias("key"), F.lit("no saved page").alias("error"))
    return {
        "matches_enriched": meta.withColumns(hashes),
        "match_lineups": lineups,
        "veto_steps": vetoes.drop("ordinal"),
        "match_maps": R.overwrite(maps, extract.map_summaries(stats), ["mapstatsid"]),
        "map_player_stats": R.reorder(players, ["match_id", "map_no"]),
        "errors": R.union_by_name([extract.errors(matches, "match_id", "match"), missing, extract.errors(stats, "mapstatsid", "map statistics")]),
    }
