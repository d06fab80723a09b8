"""Scalar functions of the library, as Column expressions: no Python runs on the data.

Missing values are null. Digits are ASCII digits. Every lenient parser gives null for what it cannot read,
also under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text that stands for a missing number.
NULL_TOKENS = ("", "-", "—", "null")
_SPACE = r"(?U)[\s\x1c-\x1f]+"


def normalized(c: Column) -> Column:
    """Runs of white space as one space, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(c.cast("string"), _SPACE, " "))


def safe_str(c: Column) -> Column:
    """normalized, with null as the empty text."""
    return F.coalesce(normalized(c), F.lit(""))


def _meant(c: Column) -> Column:
    text = safe_str(c)
    return F.when(~text.isin(*NULL_TOKENS), text)


def safe_int(c: Column) -> Column:
    text = _meant(c)
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def safe_float(c: Column) -> Column:
    """Signs + and % are dropped first; a type suffix, as in 5d, is not a number."""
    text = F.translate(_meant(c), "%+", "")
    return F.when(text.rlike(r"^\s*-?([0-9]+\.?[0-9]*|\.[0-9]+)([eE]-?[0-9]+)?\s*$") | F.lower(F.trim(text)).isin("inf", "-inf", "infinity", "-infinity", "nan"), text.try_cast("double"))


def first_int(c: Column, regex: str) -> Column:
    """Group 1 of the first match as a number."""
    return F.nullif(F.regexp_extract(c, regex, 1), F.lit("")).try_cast("bigint")


def first_text(c: Column, regex: str) -> Column:
    """Group 1 of the first match, null without one."""
    return F.nullif(F.regexp_extract(c, regex, 1), F.lit(""))


def compound_stat(c: Column) -> Column:
    """``12(5)`` as (12, 5); else the whole as a number and null."""
    text = safe_str(c)
    pair = r"^([0-9]+)\(([0-9]+)\)"
    both = text.rlike(pair)
    return F.struct(F.when(both, first_int(text, pair)).otherwise(safe_int(text)).alias("main"), F.when(both, F.regexp_extract(text, pair, 2).try_cast("bigint")).alias("inner"))


def duel_stat(c: Column) -> Column:
    """``3 : 2`` as (3, 2); else nulls."""
    text = safe_str(c)
    pair = r"^([0-9]+)\s*:\s*([0-9]+)"
    return F.struct(first_int(text, pair).alias("won"), F.nullif(F.regexp_extract(text, pair, 2), F.lit("")).try_cast("bigint").alias("lost"))


#: Patterns of ids in addresses.
MATCH_ID = r"/matches/([0-9]+)"
TEAM_ID = r"/team/([0-9]+)/"
EVENT_ID = r"/events/([0-9]+)/"
MAP_STATS_ID = r"/mapstatsid/([0-9]+)/"
STATS_TEAM_ID = r"/stats/teams/([0-9]+)/"
STATS_PLAYER_ID = r"/stats/players/([0-9]+)/"

_VETO = {
    "removed": r"^([0-9]+)\.\s+(.*?)\s+removed\s+(.+)",
    "picked": r"^([0-9]+)\.\s+(.*?)\s+picked\s+(.+)",
    "left_over": r"^([0-9]+)\.\s+(.+?)\s+was left over",
}


def veto(line: Column) -> Column:
    """A veto line as (step_number, team_name, action, map_name); null and empty texts if it is none."""
    out = F.struct(F.lit(None).cast("bigint").alias("step_number"), F.lit("").alias("team_name"), F.lit("").alias("action"), F.lit("").alias("map_name"))
    for action, regex in reversed(_VETO.items()):
        team = F.lit("") if action == "left_over" else F.trim(F.regexp_extract(line, regex, 2))
        name = F.trim(F.regexp_extract(line, regex, 2 if action == "left_over" else 3))
        got = F.struct(first_int(line, regex).alias("step_number"), team.alias("team_name"), F.lit(action).alias("action"), name.alias("map_name"))
        out = F.when(line.rlike(regex), got).otherwise(out)
    return out


def headline_date(c: Column) -> Column:
    """``Results for February 14th 2026`` as a date."""
    text = F.trim(F.replace(safe_str(c), F.lit("Results for"), F.lit("")))
    plain = F.regexp_replace(text, r"([0-9]{1,2})(st|nd|rd|th)", "$1")
    return F.to_date(F.try_to_timestamp(F.initcap(plain), F.lit("MMMM d yyyy")))


def all_digits(c: Column) -> Column:
    return c.rlike(r"^[0-9]+$")


def epoch_date(c: Column) -> Column:
    """Epoch milliseconds, all digits, as a UTC date (with the session in UTC)."""
    return F.when(all_digits(c), F.timestamp_millis(c.try_cast("bigint")).cast("date"))


def epoch_iso(c: Column) -> Column:
    """Epoch milliseconds, all digits, as ISO-8601 UTC text; else empty."""
    text = F.date_format(F.timestamp_millis(c.try_cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss")
    milli = F.when(c.try_cast("bigint") % 1000 != 0, F.concat(F.lit("."), F.lpad((c.try_cast("bigint") % 1000).cast("string"), 3, "0"), F.lit("000"))).otherwise(F.lit(""))
    return F.when(all_digits(c), F.concat(text, milli, F.lit("+00:00"))).otherwise(F.lit(""))


def lenient_timestamp(c: Column) -> Column:
    """Any ISO form; null if there is none."""
    return c.cast("string").try_cast("timestamp_ntz")


def winner(team1: Column, team2: Column, score1: Column, score2: Column) -> Column:
    """The team with the higher score; empty for a tie or a missing score."""
    return F.when(score1 > score2, team1).when(score2 > score1, team2).otherwise(F.lit(""))


def first_nonempty(a: Column, b: Column) -> Column:
    """a, or b if a is null or empty."""
    return F.coalesce(F.nullif(a, F.lit("")), b)


def coalesced(enriched: Column, raw: Column, compat: bool = False) -> Column:
    """The enriched value unless it is missing. ``compat``: only the empty text gives way to raw, null does not."""
    if compat:
        return F.when(enriched.isNull() | (enriched.cast("string") != ""), enriched).otherwise(raw)
    return F.when(enriched.isNotNull() & (enriched.cast("string") != ""), enriched).otherwise(raw)


def canonical_id(c: Column) -> Column:
    """Ids that were once written as decimals lose their ``.0``."""
    return F.regexp_replace(c, r"^([0-9]+)\.0$", "$1")


def clamped(c: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(c, high))


def absolute_url(href: Column, base: str, fallback: Column) -> Column:
    """An address as it is, a path after base, and the fallback where there is none."""
    return F.when(F.coalesce(href, F.lit("")) == "", fallback).when(href.startswith("http"), href).otherwise(F.concat(F.lit(base), href))


def roster_hash(ids: Column) -> Column:
    """Player ids in numeric order joined by dashes; repeated ids stay, nulls do not count."""
    return F.array_join(F.transform(F.array_sort(F.filter(ids, lambda x: x.isNotNull())), lambda x: x.cast("string")), "-")


def half_scores(spans: Column) -> Column:
    """Rounds by side from spans (side, rounds): first half left and right, second half left and right.

    Spans without a side or a number are skipped; with fewer than four all is null and the side empty. The
    side of the first span decides; sides swap in the second half, and overtime is ignored.
    """
    good = F.filter(spans, lambda s: s["side"].isin("CT", "T") & s["rounds"].isNotNull())
    # a lambda's argument is worked out once, a column in an expression as often as it is named
    return F.get(F.transform(F.array(good), _halves), F.lit(0))


def _halves(good: Column) -> Column:
    at = lambda k: F.get(good, F.lit(k - 1))["rounds"]
    enough, ct = F.size(good) >= 4, F.get(good, F.lit(0))["side"] == "CT"
    pick = lambda a, b: F.when(enough, F.when(ct, at(a)).otherwise(at(b)))
    return F.struct(
        pick(1, 3).alias("team1_ct_rounds"),
        pick(3, 1).alias("team1_t_rounds"),
        pick(4, 2).alias("team2_ct_rounds"),
        pick(2, 4).alias("team2_t_rounds"),
        F.when(enough, F.get(good, F.lit(0))["side"]).otherwise(F.lit("")).alias("team1_starting_side"),
    )
