"""Elo ratings: a state that runs in order over the graph of matches.

A rating after a match needs both sides' ratings before it. Teams are dealt to parts by ranges of their keys, and a round plays in
each part, in order of time, every match whose two sides have played all that they had before; the teams of others wait, and so
do the matches that they are in. A match of teams of two parts is in both, each of which sends its team's rating to the other when
the team has come to the match; when both are sent, the next round plays it. Every second round deals by other bounds, half a part
further, so that teams near a bound are well inside of a part in the next round. So each match is rated once, by the rule of
a plain loop, and a round reads only what waits. Where teams with keys near each other meet, rounds are few; at most there is one more
than a chain of matches is long, which keys that tell nothing come near to. A task holds the ratings of its teams.

``wave`` of a match is one more than that of the matches that its sides played last: how long the chain of matches before it is.

Matches are written by block of time, and each block is rated before the next is read (``block`` None: all in one, which takes
the fewest rounds and waves). What a round makes is written out; a lost executor costs one round.

Order is by time and then match id. Matches without an id, a time or a side, or of a team with itself, are not rated.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder

K = 32.0
BASE = 1500.0
SCALE = 400.0
BLOCK = "year"
#: Matches that are worth a part of their own, and teams asked for a bound between parts.
PART_MATCHES = 50_000
PART_ASKED = 200
#: Kinds of rows: ratings of teams that wait, what is sent at a match, matches, in the order in which a part reads them; matches
#: that are rated, and the ratings of teams that have played all their matches of a block.
STATE, SENT, MATCH, RATED, REST = range(5)


def expected(own: Column, other: Column, scale: float = SCALE) -> Column:
    """The share of points that ratings promise."""
    return 1 / (1 + F.pow(F.lit(10.0), (other - own) / scale))


def rate(matches: DataFrame, k: float = K, base: float = BASE, scale: float = SCALE, block: str | None = BLOCK, parts: int | None = None) -> DataFrame:
    """Ratings around each of the matches (match_id, when, a, b, score of a from 0 to 1).

    Returns (match_id, when, wave, a, b, score, a_before, b_before, expected, a_after, b_after); waves count from 1 over all blocks.
    """
    spark = matches.sparkSession
    folder = f"{shared_folder(spark)}/elo-{uuid4().hex}"
    good = matches.filter("match_id is not null and when is not null and a is not null and b is not null and a <> b")
    at = (F.date_format(F.date_trunc(block, "when"), "yyyy-MM-dd-HH") if block else F.lit("all")).alias("block")
    sides = F.array("a", "b")  # of one type
    good = good.select(at, "when", "match_id", F.monotonically_increasing_id().alias("n"), sides[0].alias("a"), sides[1].alias("b"), F.col("score").cast("double").alias("score"))
    good.write.partitionBy("block").parquet(f"{folder}/matches")
    every = spark.read.schema(good.schema).parquet(f"{folder}/matches")
    sizes = {r[0]: r[1] for r in every.groupBy("block").agg(F.count("*")).collect()}  # of the calendar
    n = sum(sizes.values())
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_parts = lambda waits: parts or max(1, min(most, waits // PART_MATCHES))
    asked = _asked(every, n, in_parts(n))
    row = [*_MATCH, *[F.lit(None).cast(kind).alias(name) for name, (kind, _) in _OTHER.items()]]
    schema = every.select(*row).schema
    told, state, wave = [], None, 0
    for number, name in enumerate(sorted(sizes)):
        last = number == len(sizes) - 1
        todo = every.filter(F.col("block") == F.lit(name)).select(*row).withColumn("kind", F.lit(MATCH))
        if state is not None:
            todo = todo.unionByName(state.withColumn("kind", F.lit(STATE)))
        turn, paths, waits = 0, [], sizes[name]
        while True:
            p = in_parts(waits)  # less that waits goes to fewer parts, in which more can be rated
            paths.append(f"{folder}/rounds/{number}-{turn}")
            dealt = todo.mapInArrow(_dealt(_bounds(asked, p, turn % 2)), schema).repartitionById(p + 1, "part").sortWithinPartitions("when", "match_id", "n", "kind")
            dealt.mapInArrow(_round(k, base, scale, wave, last), schema).write.parquet(paths[-1])
            todo = spark.read.schema(schema).parquet(paths[-1]).filter(F.col("kind") < RATED)
            waits = todo.filter(F.col("kind") == MATCH).count()
            if waits == 0:
                break
            turn += 1
        told += paths
        if not last:
            rest = spark.read.schema(schema).parquet(*paths).filter(F.col("kind") == REST)
            # teams that are not in this block keep what they have
            state = rest if state is None else rest.unionByName(state.join(rest.select("a"), "a", "left_anti").select(*rest.columns))
            wave = rest.agg(F.max("wave")).first()[0]
            state.write.parquet(f"{folder}/ratings/{number}")
            state = spark.read.schema(schema).parquet(f"{folder}/ratings/{number}")
    if not told:  # every is empty
        return every.select(*_TOLD[:2], F.lit(0).alias("wave"), *_TOLD[3:6], *[F.lit(base).alias(c) for c in _TOLD[6:]])
    return spark.read.schema(schema).parquet(*told).filter(F.col("kind") == RATED).select(*_TOLD)


_MATCH = ("when", "match_id", "n", "a", "b", "score")
_TOLD = ("match_id", "when", "wave", "a", "b", "score", "a_before", "b_before", "expected", "a_after", "b_after")
#: The other columns of a row. A match: the side that is in the part (0: both). What is sent: whose rating it is, and the rating
#: and wave of that side. A state: a team (in a), its rating and wave.
_OTHER = {"part": ("int", pa.int32()), "kind": ("int", pa.int32()), "side": ("int", pa.int32()), "rating": ("double", pa.float64()), "wave": ("int", pa.int32())} | {
    c: ("double", pa.float64()) for c in ("a_before", "b_before", "expected", "a_after", "b_after")
}


def _asked(matches: DataFrame, n: int, parts: int) -> list:
    """Some teams in order, to set bounds by, as a sort does: they say only where a match is rated."""
    if parts == 1 or not n:
        return []
    return sorted(r[0] for r in matches.select(F.explode(F.array("a", "b"))).sample(min(1.0, PART_ASKED * parts / n), 1).collect())


def _bounds(asked: list, parts: int, shifted: int) -> list:
    """The last team of each part but the last; shifted: of parts that begin in the middle of these."""
    if parts == 1 or not asked:
        return []
    return sorted({asked[max(len(asked) * h // (2 * parts) - 1, 0)] for h in range(2 - shifted, 2 * parts, 2)})


def _rows(of: pa.RecordBatch, at: list[int], **other: list) -> pa.RecordBatch:
    """The matches at these places of a batch with other columns."""
    cols = [of.column(c).take(pa.array(at, pa.int64())) for c in _MATCH]
    cols += [pa.array(other[c], kind) if c in other else pa.nulls(len(at), kind) for c, (_, kind) in _OTHER.items()]
    return pa.RecordBatch.from_arrays(cols, [*_MATCH, *_OTHER])


def _dealt(bounds: list):
    """Rows to the parts of their teams: those of a match of two parts to both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, part, side = [], [], []
            for x, (a, b, kind, which) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("a", "b", "kind", "side")])):
                p = q = bisect_left(bounds, a)
                if kind != STATE:
                    q = bisect_left(bounds, b)
                if p != q:
                    at += x, x
                    part += p, q
                    side += (which, which) if kind == SENT else (1, 2)
                elif kind != SENT:  # of a side that is here
                    at.append(x)
                    part.append(p)
                    side.append(0)
            same = {c: batch.column(c).take(pa.array(at, pa.int64())) for c in ("kind", "rating", "wave")}
            yield _rows(batch, at, part=part, side=side, **same)

    return run


def _share(gap: float) -> float:
    """1 / (1 + 10 ** gap), with gaps that are too large for a number."""
    return 0.0 if gap > 308 else 1 / (1 + 10.0**gap)


def _round(k: float, base: float, scale: float, floor: int, last: bool):
    """All that can be rated in a part, in order of time; what cannot waits, and so do its teams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratings, waiting, new, batch = {}, set(), (base, floor), None
        came, came_for = {}, None
        for batch in batches:
            rated, left, sends = [], [], []
            for x, (n, a, b, score, kind, side, rating, wave) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("n", "a", "b", "score", "kind", "side", "rating", "wave")])):
                if kind == STATE:
                    ratings[a] = (rating, max(wave, floor))
                    continue
                if kind == SENT:
                    came = came if came_for == n else {}
                    came[side], came_for = (rating, wave), n
                    continue
                if side:
                    own = a if side == 1 else b
                    both = came if came_for == n else {}
                    if len(both) < 2:
                        if own not in waiting:
                            sends.append((x, side, *ratings.get(own, new)))
                            waiting.add(own)
                        if side == 1:
                            left.append(x)
                        continue
                    (ra, wa), (rb, wb) = both[1], both[2]
                elif a in waiting or b in waiting:
                    waiting.add(a)
                    waiting.add(b)
                    left.append(x)
                    continue
                else:
                    (ra, wa), (rb, wb) = ratings.get(a, new), ratings.get(b, new)
                e, wave = _share((rb - ra) / scale), 1 + max(wa, wb)
                after_a, after_b = ra, rb
                if score is not None:
                    after_a, after_b = ra + k * (score - e), rb + k * (1 - score - _share((ra - rb) / scale))
                if side != 2:
                    ratings[a] = (after_a, wave)
                    rated.append((x, wave, ra, rb, e, after_a, after_b))
                if side != 1:
                    ratings[b] = (after_b, wave)
            if rated:
                at, wave, *numbers = zip(*rated)
                yield _rows(batch, at, kind=[RATED] * len(at), wave=wave, **dict(zip(_TOLD[6:], numbers)))
            if left:
                yield _rows(batch, left, kind=[MATCH] * len(left))
            if sends:
                at, side, rating, wave = zip(*sends)
                yield _rows(batch, at, kind=[SENT] * len(at), side=side, rating=rating, wave=wave)
        # a team that waits and has no rating yet needs none
        teams = [t for t in ratings if t in waiting or not last]
        for first in range(0, len(teams), 10_000):
            some = teams[first : first + 10_000]
            held = {"a": some, "kind": [STATE if t in waiting else REST for t in some], "rating": [ratings[t][0] for t in some], "wave": [ratings[t][1] for t in some]}
            yield pa.RecordBatch.from_arrays([pa.array(held[f.name], f.type) if f.name in held else pa.nulls(len(some), f.type) for f in _rows(batch, []).schema], [*_MATCH, *_OTHER])

    return run
