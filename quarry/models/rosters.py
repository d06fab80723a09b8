"""Rosters over time: who stood in a team from when to when, and whose tenures overlap.

A tenure is a run of a team's matches in a row with the same player. Matches are numbered within a team and a block of time, so
a team with very many matches is worked on in parts, and runs are found in the same parts; only runs that touch an edge of
their block are numbered through the blocks and joined after that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settled
from .asof import BLOCK, _block, day


def _runs(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, first, last, start, stop) in which what follows one another without a gap is one row."""
    order = Window.partitionBy(*keys).orderBy("first")
    begins = F.coalesce((F.lag("last").over(order) + 1 < F.col("first")).cast("int"), F.lit(1))
    run = F.sum("begins").over(order)
    rows = rows.withColumn("begins", begins).withColumn("run", run)
    return rows.groupBy(*keys, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def tenures(lineups: DataFrame, team: str = "team", when: str = "when", match: str = "match", player: str = "player", block: str = BLOCK) -> DataFrame:
    """(team, player, start, stop, n_matches) of each tenure; start and stop are its first and last day, as days since 1970.

    A match's day is one of its team's; rows without a team, day, match or player are left out; a player twice in a lineup counts once.
    """
    rows = lineups.select(F.col(team).alias("team"), day(when).alias("day"), F.col(match).alias("match"), F.col(player).alias("player")).dropna(subset=["team", "day", "match"]).distinct()
    # a match without a known player has a number too
    of = Window.partitionBy("team", "block")
    rows = rows.withColumn("block", _block(F.col("day"), block)).withColumn("number", F.dense_rank().over(of.orderBy("day", "match"))).withColumn("size", F.max("number").over(of))
    # in a run numbers grow as rows do
    run = F.col("number") - F.row_number().over(Window.partitionBy("team", "block", "player").orderBy("number"))
    ends = [f(c).alias(n) for n, f, c in (("first", F.min, "number"), ("last", F.max, "number"), ("start", F.min, "day"), ("stop", F.max, "day"), ("size", F.max, "size"))]
    runs = settled(rows.withColumn("run", run).groupBy("team", "block", "player", "run").agg(*ends))
    edge = (F.col("first") == 1) | (F.col("last") == F.col("size"))
    edges, inner = runs.filter(edge), runs.filter(~edge)
    sizes = edges.groupBy("team", "block").agg(F.max("size").alias("size"))
    earlier = Window.partitionBy("team").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("team", "block", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    moved = {c: F.col(c) + F.col("before") for c in ("first", "last")}
    edges = _runs(edges.join(before, ["team", "block"]).withColumns(moved), ["team", "player"])
    runs = inner.select(*edges.columns).unionByName(edges).filter("player is not null")
    return runs.select("team", "player", "start", "stop", (F.col("last") - F.col("first") + 1).cast("long").alias("n_matches"))


def overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], on: Column) -> DataFrame:
    """Pairs (l, r), structs of the rows of left and right, of equal keys whose whole numbers start to stop have one in common.

    ``on`` is a condition on l and r that pairs have to meet. Time is halved into buckets of all powers of two: an interval
    has a level at which it lies in two buckets at most, and a pair meets at the higher of its two levels, in the first
    bucket that both have. So an interval of any length makes at most two rows a level, and no pair comes twice.
    """
    # of the powers of two those that an interval has: 32 at most
    used = left.select(_own().alias("own")).union(right.select(_own().alias("own"))).distinct()
    used = sorted(r["own"] for r in used.collect() if r["own"] is not None) or [0]
    a, b = _levels(left, keys, "l", used), _levels(right, keys, "r", used)
    names = [f"k{n}" for n in range(len(keys))]
    met = a.join(b, [*names, "level", "bucket"]).filter(F.col("l_own") | F.col("r_own")).filter("l.start <= r.stop and r.start <= l.stop")
    first = F.greatest(F.col("l.start"), F.col("r.start"))
    return met.filter((F.col("bucket") == F.floor(first / F.pow(F.lit(2.0), F.col("level"))).cast("long")) & on).select("l", "r")


def _own() -> Column:
    """The level of an interval: 2 ** level >= its length, so that two buckets hold it."""
    return F.when(F.col("start") <= F.col("stop"), F.ceil(F.log2(F.col("stop") - F.col("start") + 1))).cast("int")


def _levels(rows: DataFrame, keys: Sequence[str], name: str, used: Sequence[int]) -> DataFrame:
    rows = rows.filter("start <= stop").select(F.struct(*rows.columns).alias(name), *[F.col(k).alias(f"k{n}") for n, k in enumerate(keys)], "start", "stop", _own().alias("own"))
    at = lambda c, k: F.floor(F.col(c) / F.pow(F.lit(2.0), k)).cast("long")
    places = lambda k: F.transform(F.array_distinct(F.array(at("start", k), at("stop", k))), lambda x: F.struct(k.alias("level"), x.alias("bucket")))
    levels = F.filter(F.array(*[F.lit(k) for k in used]), lambda k: k >= F.col("own"))
    names = [f"k{n}" for n in range(len(keys))]
    rows = rows.select(name, *names, "own", F.inline(F.flatten(F.transform(levels, places))))
    return rows.select(name, *names, "level", "bucket", (F.col("level") == F.col("own")).alias(f"{name}_own"))
