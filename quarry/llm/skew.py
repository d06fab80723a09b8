"""Joins with one row a key, where a key may have a third of the other side's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import settled

#: Keys with fewer rows are no burden to a task.
PART = 256
#: Of any table fewer than so many keys have more than a part in so many of the rows.
FEW = 500_000


def often(many: DataFrame, keys: list[str], weight: str | None = None, least: int | None = None) -> DataFrame | None:
    """(keys, k), a table, of the keys with more than ``least`` rows (or that much weight) and more than a part in FEW of all.

    There are fewer than FEW of them by that, whatever the table, so they can be sent to all tasks; any other key has a
    part in FEW of the rows at most. The rows are summed only where that many keys pass the first bound. None if there is no such key.
    """
    k = F.sum(weight) if weight else F.count("*")
    found = settled(many.groupBy(*keys).agg(k.alias("k")).filter(F.col("k") > (PART if least is None else least)))
    if found.isEmpty():
        return None
    if found.count() >= FEW:
        found = found.filter(F.col("k") > (many.agg(k).first()[0] or 0) // FEW)
    return found


def dealt(many: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """many joined with one, which has a row a key at most; rows of keys with many rows stay where they are.

    many is read several times: a table, or cheap to make.
    """
    hot = often(many, keys)
    if hot is None:
        return many.join(one, keys)
    few = settled(hot.select(*keys).join(one, keys))
    rest = many.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return many.join(F.broadcast(few), keys).unionByName(rest.join(one, keys))


def parted(rows: DataFrame, keys: list[str], by: str, name: str, weight: str | None = None, least: int | None = None) -> DataFrame:
    """rows, a table, with the part, of the column ``name``, of its key that a row belongs to by the hash of ``by``, and ``name``s, the
    number of parts: a table too, which is written only where a key has parts."""
    hot = often(rows, keys, weight, least)
    if hot is None:
        return rows.withColumn(f"{name}s", F.lit(1)).withColumn(name, F.lit(0))
    parts = hot.select(*keys, F.ceil(F.col("k") / (PART if least is None else least)).cast("int").alias(f"{name}s"))
    rows = rows.join(F.broadcast(parts), keys, "left").withColumn(f"{name}s", F.coalesce(f"{name}s", F.lit(1)))
    return settled(rows.withColumn(name, F.pmod(F.xxhash64(by), F.col(f"{name}s")).cast("int")))
