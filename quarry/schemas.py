"""Schemas of the relations, in column order."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "int": T.IntegerType(), "timestamp": T.TimestampType()}


def _schema(text: str) -> T.StructType:
    """Columns as ``name type``, with commas between."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in text.split(","))])


MATCHES_RAW = _schema(
    "match_id string, match_date date, event_id string, event_name string, team1 string, team2 string, team1_score long, team2_score long, winner string, game string, completed boolean, "
    "is_professional_proxy boolean, professional_filter_note string, source string, source_url string"
)
MATCHES_ENRICHED = _schema(
    "match_id string, match_date date, match_datetime_utc timestamp, event_id string, event_name string, team1 string, team2 string, team1_id string, team2_id string, team1_rank long, team2_rank long, bo long, "
    "lan_online string, match_context string, forfeit_note string, winner_raw string, source_url string, team1_roster_hash string, team2_roster_hash string"
)
MATCH_LINEUPS = _schema("match_id string, team_ordinal int, team_id string, team_name string, player_id string, player_name string, country string")
VETO_STEPS = _schema("match_id string, step_number long, team_name string, action string, map_name string, raw_line string")
MATCH_MAPS = _schema(
    "match_id string, map_no int, map_name string, played boolean, optional boolean, is_default_forfeit_map boolean, team1_map_score long, team2_map_score long, mapstatsid string, stats_href string, picked_by string, is_decider boolean, "
    "team1_ct_rounds long, team1_t_rounds long, team2_ct_rounds long, team2_t_rounds long, team1_starting_side string, "
    "map_name_from_stats string, team_left_id string, team_left_name string, team_right_id string, team_right_name string, team_left_score_stats long, team_right_score_stats long, "
    "team_left_ct_rounds long, team_left_t_rounds long, team_right_ct_rounds long, team_right_t_rounds long, team_left_starting_side string"
)
MAP_PLAYER_STATS = _schema(
    "match_id string, map_no int, mapstatsid string, team_id string, player_id string, player_name string, kills long, hs_kills long, assists long, flash_assists long, deaths long, traded_deaths long, "
    "adr double, kast double, opening_kills long, opening_deaths long, rating double, multi_kills long, clutch_wins long, round_swing double"
)
RAW_REQUIRED = ("match_id", "match_date", "event_name", "team1", "team2", "team1_score", "team2_score", "winner", "source_url")
#: The columns that come first in the final table.
FINAL_FIRST = (
    "match_id", "match_date", "match_datetime_utc", "event_id", "event_name", "team1", "team2", "team1_id", "team2_id", "team1_score", "team2_score", "winner", "team1_rank", "team2_rank", "bo", "lan_online",
    "match_context", "forfeit_note", "team1_roster_hash", "team2_roster_hash", "source", "source_url", "game", "game_version_policy",
    "game_version_cutoff_date", "completed", "is_professional_proxy", "professional_filter_note",
)
KEYS = {
    "matches_enriched": ("match_id",),
    "match_lineups": ("match_id", "team_ordinal", "player_id"),
    "veto_steps": ("match_id", "step_number", "action", "map_name", "team_name"),
    "match_maps": ("match_id", "map_no"),
    "map_player_stats": ("match_id", "map_no", "player_id"),
}
TABLES = {"matches_enriched": MATCHES_ENRICHED, "match_lineups": MATCH_LINEUPS, "veto_steps": VETO_STEPS, "match_maps": MATCH_MAPS, "map_player_stats": MAP_PLAYER_STATS}


def as_text(schema: T.StructType) -> T.StructType:
    """The same columns, read as text: typed afterwards with lenient parsers."""
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
