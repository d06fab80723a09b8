"""Features as of a point in time: only what was known before a row's day goes into them.

A key may have a third of all rows, so no window runs over all rows of a key: windows are of a key and a block of time, and
what earlier blocks hold comes in as one row at the block's beginning, made of one aggregated row a key and block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.relational import free_name

BLOCK = "month"


def day(c: str | Column) -> Column:
    """Days since 1970-01-01 of a date or time."""
    return F.unix_date(F.col(c).cast("date") if isinstance(c, str) else c.cast("date"))


def _block(days: Column, block: str) -> Column:
    """The first day of the block of a day."""
    return F.unix_date(F.date_trunc(block, F.date_from_unix_date(days).cast("timestamp")).cast("date"))


def sums_before(rows: DataFrame, keys: Sequence[str], when: str, sums: dict[str, Column], block: str = BLOCK) -> DataFrame:
    """rows with, for each name of ``sums``, the sum of that column over rows of the key on earlier days (0 if there are none).

    Missing values add nothing. Rows without a date have null sums and count for none.
    """
    row, names = free_name("row", rows), list(sums)
    packed = rows.select(F.struct(*rows.columns).alias(row), *[F.col(k).alias(f"{row}k{n}") for n, k in enumerate(keys)], day(when).alias(f"{row}d"), *[F.coalesce(c, F.lit(0)).alias(f"{row}s{n}") for n, c in enumerate(sums.values())])
    ks, d, b = [f"{row}k{n}" for n in range(len(keys))], f"{row}d", f"{row}b"
    ss = [f"{row}s{n}" for n in range(len(names))]
    packed = packed.withColumn(b, _block(F.col(d), block))
    totals = packed.filter(F.col(d).isNotNull()).groupBy(*ks, b).agg(*[F.sum(s).alias(s) for s in ss])
    earlier = Window.partitionBy(*ks).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*ks, b, (F.col(b) - 1).alias(d), *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(s) for s in ss])
    both = packed.unionByName(carried, allowMissingColumns=True)
    before = Window.partitionBy(*ks, b).orderBy(d).rangeBetween(Window.unboundedPreceding, -1)
    out = both.select(row, *[F.when(F.col(d).isNotNull(), F.sum(s).over(before)).alias(n) for n, s in zip(names, ss)])
    return out.filter(F.col(row).isNotNull()).select(f"{row}.*", *names)


def join_before(left: DataFrame, right: DataFrame, keys: Sequence[str], when: str, values: dict[str, Column], order: Sequence[str], block: str = BLOCK) -> DataFrame:
    """left with ``values`` of the last row of right of the same key and an earlier day; of one day the last by ``order``.

    Rows without a date find nothing and are found by none; null keys are equal. A value may be null in the row that is found.
    """
    row = free_name("row", left, right)
    ks, d, b, v = [f"{row}k{n}" for n in range(len(keys))], f"{row}d", f"{row}b", f"{row}v"
    named = [F.col(k).alias(f"{row}k{n}") for n, k in enumerate(keys)]
    known = F.struct(day(when).alias("d"), F.struct(*order).alias("o"), F.struct(*[c.alias(n) for n, c in values.items()]).alias("v"))
    ours = left.select(F.struct(*left.columns).alias(row), *named, day(when).alias(d)).withColumn(b, _block(F.col(d), block))
    theirs = right.filter(F.col(when).isNotNull()).select(*named, day(when).alias(d), known.alias(v)).withColumn(b, _block(F.col(d), block))
    # one row a key, block and day is enough; then what the blocks before hold, for each block with rows of left
    theirs = theirs.groupBy(*ks, b, d).agg(F.max(v).alias(v))
    last = theirs.groupBy(*ks, b).agg(F.max(v).alias(v))
    every = last.unionByName(ours.filter(F.col(d).isNotNull()).select(*ks, b).distinct(), allowMissingColumns=True).groupBy(*ks, b).agg(F.max(v).alias(v))
    earlier = Window.partitionBy(*ks).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(*ks, b, (F.col(b) - 1).alias(d), F.max(v).over(earlier).alias(v))
    both = ours.unionByName(theirs, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    before = Window.partitionBy(*ks, b).orderBy(d).rangeBetween(Window.unboundedPreceding, -1)
    out = both.select(row, F.when(F.col(d).isNotNull(), F.max(v).over(before)).alias(v)).filter(F.col(row).isNotNull())
    return out.select(f"{row}.*", *[F.col(f"{v}.v.{n}").alias(n) for n in values])
