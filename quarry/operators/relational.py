"""Relational operators with explicit order: which row stays never depends on how data happen to arrive.

Keep-first and keep-last take one row per key with a row_number of 1, which Spark plans with a group limit
before the shuffle, so a key with very many rows sends only a few of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import coalesced, normalized, safe_str

BATCH, ROW = "__batch", "__row"


def expect_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """df, or an error that lists what it lacks in order."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def clean_names(df: DataFrame) -> DataFrame:
    """Names trimmed, in lower case, with underscores; an error if two become one."""
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"columns collide: {twice}")
    return df.toDF(*names)


def reorder(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """Columns of ``first`` that exist, then the others in their order."""
    front = [c for c in first if c in df.columns]
    return df.select(*front, *[c for c in df.columns if c not in front])


def normalize_text(df: DataFrame, columns: Sequence[str] | None = None, compat: bool = False) -> DataFrame:
    """White space normalised in all text columns. ``compat``: missing text becomes the text ``nan``."""
    chosen = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)]
    out = {c: F.coalesce(normalized(F.col(c)), F.lit("nan")) if compat else normalized(F.col(c)) for c in chosen}
    return df.withColumns(out) if out else df


def free_name(name: str, *frames: DataFrame) -> str:
    """name, longer by underscores until no frame has it."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    present = [k for k in keys if k in df.columns]
    if not present:
        return df
    if not order:
        raise ValueError("an order is needed to say which row stays")
    rank = F.row_number().over(Window.partitionBy(*present).orderBy(*order))
    name = free_name("rank", df)
    return df.withColumn(name, rank).filter(F.col(name) == 1).drop(name)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order; keys that do not exist are left out, null keys are equal."""
    return _one_per_key(df, keys, order)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The last row of each key where ``order`` sorts ascending with nulls first; pass Columns for another order."""
    return _one_per_key(df, keys, [F.desc_nulls_last(c) if isinstance(c, str) else c for c in order])


def keep_last_arrival(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last row of each key by batch and row number within the batch."""
    return keep_last(df, keys, [BATCH, ROW])


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by name; what a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def semi_filter(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ids; df as it is without the key column."""
    return df.join(ids.select(key).distinct(), key, "left_semi") if key in df.columns else df


def flag_existence(df: DataFrame, other: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """df with a boolean: whether other has the key."""
    marks = other.select(*on).distinct().withColumn(name, F.lit(True))
    return df.join(marks, list(on), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def backfill(df: DataFrame, lookup: DataFrame, key: str, column: str, after: str | None = None) -> DataFrame:
    """df with a column of the distinct (key, column) of lookup; df as it is if it has the column or is without the key."""
    if column in df.columns or key not in df.columns:
        return df
    out = df.join(lookup.select(key, column).distinct(), key, "left")
    return reorder(out, [after or key, column])


def coalesce_join(left: DataFrame, right: DataFrame, key: str, pairs: Sequence[str], left_suffix: str = "_raw", right_suffix: str = "_enriched", compat: bool = False) -> DataFrame:
    """Left join with suffixes for columns of both; for each of ``pairs`` one column again, of right if it has a value."""
    both = [c for c in left.columns if c in right.columns and c != key]
    a = left.withColumnsRenamed({c: c + left_suffix for c in both})
    b = right.withColumnsRenamed({c: c + right_suffix for c in both})
    out = a.join(b, key, "left")
    merged = [c for c in pairs if c in both]
    out = out.withColumns({c: coalesced(F.col(c + right_suffix), F.col(c + left_suffix), compat) for c in merged}) if merged else out
    return out.drop(*[c + s for c in merged for s in (left_suffix, right_suffix)])


def overwrite(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join where values of other that are neither null nor empty replace those of df; zero and false do replace."""
    values, kinds, fresh = [c for c in other.columns if c not in on], dict(other.dtypes), free_name("fresh", df, other)
    new = F.struct(*[(F.nullif(F.col(c), F.lit("")) if kinds[c] == "string" else F.col(c)).alias(c) for c in values]) if values else F.lit(None)
    out = df.join(other.select(*on, new.alias(fresh)), list(on), "left")
    got = {c: F.col(fresh).getField(c) for c in values}
    return out.withColumns({c: F.coalesce(v, F.col(c)) if c in df.columns else v for c, v in got.items()}).drop(fresh)


def last_wins(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """One row a key: the value with the largest order."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def joined_text(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], sep: str, name: str) -> DataFrame:
    """Values of each key as one text, in order. The groups are those of one document or match."""
    rows = F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("order"), F.col(value).cast("string").alias("text"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["text"]), sep).alias(name))


#: Names that stand for a team that is not known.
UNKNOWN_TEAMS = ("TBD", "Unknown", "", "-", "—")


def valid_matches(df: DataFrame, start, end) -> DataFrame:
    """Rows of finished matches: date within the range, two different known teams, two different scores, a winner."""
    known = ~safe_str(F.col("team1")).isin(*UNKNOWN_TEAMS) & ~safe_str(F.col("team2")).isin(*UNKNOWN_TEAMS)
    return df.filter(
        F.col("match_date").between(F.lit(start), F.lit(end))
        & known
        & (F.col("team1") != F.col("team2"))
        & F.col("team1_score").isNotNull()
        & F.col("team2_score").isNotNull()
        & (F.col("team1_score") != F.col("team2_score"))
        & (F.coalesce("winner", F.lit("")) != "")
    )


def until_stop(df: DataFrame, order: str, stop: Column) -> DataFrame:
    """Rows up to the first for which stop holds, that one included: a minimum found first, so no row passes one task."""
    name = free_name("stop", df)
    first = df.filter(stop).agg(F.min(order).alias(name))
    return df.join(F.broadcast(first), F.col(name).isNull() | (F.col(order) <= F.col(name))).drop(name)


def page_slice(df: DataFrame, order: Sequence[Column], offset: int = 0, limit: int = 0) -> DataFrame:
    """Rows in order after ``offset``, ``limit`` of them at most (all if it is not above 0)."""
    out = df.orderBy(*order)
    out = out.offset(offset) if offset > 0 else out
    return out.limit(limit) if limit > 0 else out


def counts(**frames: DataFrame) -> DataFrame:
    """(relation, rows) of several frames, in one job."""
    return reduce(DataFrame.unionAll, [f.agg(F.lit(n).alias("relation"), F.count("*").alias("rows")) for n, f in frames.items()])


def date_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("first"), F.max(column).alias("last"), F.count("*").alias("rows"))
