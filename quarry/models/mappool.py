"""Sums that decay: what a team has done on a map, recent matches counting more.

A decayed sum is an associative scan: a part is (its last time, its sum as of then), and a part is joined to the next by decaying
the first to the second's time. It runs within a key and a block of time as a plain window sum of terms weighted by the time
since the block's beginning, over the blocks of a key as a fold of one number a block, and the fold's result comes back as one
row at the beginning of each block. So a key with a third of all rows is worked on in parts, and no weight grows with the
length of history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.relational import free_name
from .asof import _block, day

HALF_LIFE = 90.0
BLOCK = "quarter"


def decayed_before(rows: DataFrame, keys: Sequence[str], when: str, sums: dict[str, Column], half_life: float = HALF_LIFE, block: str = BLOCK) -> DataFrame:
    """rows with, for each name of ``sums``, the sum of that column over earlier days of the key, a half as much for each half life (in days) ago.

    0 where nothing is earlier; missing values add nothing; rows without a date have null sums and count for none. A half life
    should not be much shorter than a hundredth of the block, as weights within a block are powers of two of their ratio.
    """
    row, names = free_name("row", rows), list(sums)
    ks, d, b = [f"{row}k{n}" for n in range(len(keys))], f"{row}d", f"{row}b"
    ss = [f"{row}s{n}" for n in range(len(names))]
    weight = lambda span: F.pow(F.lit(2.0), span / half_life)
    packed = rows.select(F.struct(*rows.columns).alias(row), *[F.col(k).alias(c) for k, c in zip(keys, ks)], day(when).alias(d), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(s) for c, s in zip(sums.values(), ss)])
    packed = packed.withColumn(b, _block(F.col(d), block))
    packed = packed.withColumns({s: F.col(s) * weight(F.col(d) - F.col(b)) for s in ss})
    totals = packed.filter(F.col(d).isNotNull()).groupBy(*ks, b).agg(*[F.sum(s).alias(s) for s in ss])
    # one row a key with a row a block of the calendar
    per = totals.groupBy(*ks).agg(F.sort_array(F.collect_list(F.struct(b, *ss))).alias("blocks"))

    def step(done: Column, now: Column) -> Column:
        span = now[b] - done["at"]
        fresh = [(((done[s] + done[f"{s}_in"]) * weight(-span)).alias(s)) for s in ss]
        out = F.struct(now[b].alias(b), *fresh)
        return F.struct(now[b].alias("at"), *fresh, *[now[s].alias(f"{s}_in") for s in ss], F.concat(done["out"], F.array(out)).alias("out"))

    kinds = ", ".join(f"{s}: double" for s in ss)
    start = F.struct(F.element_at("blocks", 1)[b].alias("at"), *[F.lit(0.0).alias(s) for s in ss], *[F.lit(0.0).alias(f"{s}_in") for s in ss], F.expr(f"cast(array() as array<struct<{b}: int, {kinds}>>)").alias("out"))
    carried = per.select(*ks, F.inline(F.aggregate("blocks", start, step, lambda x: x["out"])))
    # as a row of the day before the block, so that the block's first day sees it
    carried = carried.select(*ks, b, (F.col(b) - 1).alias(d), *ss)
    both = packed.unionByName(carried, allowMissingColumns=True)
    before = Window.partitionBy(*ks, b).orderBy(d).rangeBetween(Window.unboundedPreceding, -1)
    found = {n: F.when(F.col(d).isNotNull(), F.coalesce(F.sum(s).over(before), F.lit(0.0)) * weight(F.col(b) - F.col(d))) for n, s in zip(names, ss)}
    return both.select(row, *[c.alias(n) for n, c in found.items()]).filter(F.col(row).isNotNull()).select(f"{row}.*", *names)
