"""Data audit by mergeable sketches: one pass over a table makes a row of summaries a day, and any span of days is a merge of rows.

For each column: rows, nulls, an HLL sketch of distinct values and one of frequent ones (approx_top_k); for numbers also
least, greatest, and a KLL sketch of quantiles. All of them merge, so a day's row is made once, kept, and never read again with
its data. Keys and references are counted exactly: rows with a repeated key, and rows whose reference has no partner.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LG_CONFIG = 12  # HLL: relative error 1.04 / sqrt(2 ** 12)
KLL = 400  # KLL: rank error below 1 per cent
ITEMS = 1000
TOP = 10
"""Frequent items are exact up to ITEMS distinct values of a day, and otherwise off by rows / ITEMS at most."""


def _number(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.NumericType)


def _text(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.StringType)


def summarize(rows: DataFrame, when: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(day, column, rows, nulls, low, high, distinct, quantiles, frequent): a row a day and column, of one pass.

    low and high are of numbers as doubles; distinct, quantiles (of numbers) and frequent (values as text) are sketches. Rows without
    a date have a row without a day.
    """
    fields = [f for f in rows.schema if f.name != when and (columns is None or f.name in columns) and (_number(f) or _text(f))]
    of: list[Column] = []
    for n, f in enumerate(fields):
        c = F.col(f.name)
        number = c.cast("double") if _number(f) else F.lit(None).cast("double")
        of.append(F.count_if(c.isNull()).alias(f"nulls{n}"))
        of.append(F.hll_sketch_agg(F.xxhash64(c), F.lit(LG_CONFIG)).alias(f"distinct{n}"))
        of += [F.min(number).alias(f"low{n}"), F.max(number).alias(f"high{n}")]
        of.append((F.kll_sketch_agg_double(number, F.lit(KLL)) if _number(f) else F.lit(None).cast("binary")).alias(f"quantiles{n}"))
        of.append(F.expr(f"approx_top_k_accumulate(cast(`{f.name}` as string), {ITEMS})").alias(f"frequent{n}"))
    wide = rows.groupBy(F.col(when).cast("date").alias("day")).agg(F.count("*").alias("rows"), *of)
    kinds = ("nulls", "low", "high", "distinct", "quantiles", "frequent")
    each = [F.struct(F.lit(f.name).alias("column"), "rows", *[F.col(f"{c}{n}").alias(c) for c in kinds]) for n, f in enumerate(fields)]
    return wide.select("day", F.inline(F.array(*each)))


def merged(parts: DataFrame, by: Sequence[Column | str] = ()) -> DataFrame:
    """Summaries of spans of days from those of days: one row for each column and each value of ``by``."""
    return parts.groupBy(*by, "column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.expr("approx_top_k_combine(frequent)").alias("frequent"),
    )


def report(parts: DataFrame, ranks: Sequence[float] = (0.25, 0.5, 0.75), top: int = TOP) -> DataFrame:
    """What summaries say: rows, nulls, distinct values, least, greatest, quantiles at ranks, and the most frequent values."""
    at = F.array(*[F.lit(float(r)) for r in ranks])
    return parts.select(
        *[c for c in parts.columns if c not in ("distinct", "quantiles", "frequent")],
        F.hll_sketch_estimate("distinct").alias("n_distinct"),
        F.when(F.col("high").isNotNull(), F.kll_sketch_get_quantile_double("quantiles", at)).alias("quantiles"),
        F.expr(f"approx_top_k_estimate(frequent, {top})").alias("frequent"),
    )


def repeated_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, rows) of keys that more than one row has."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def broken_references(rows: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """Rows whose value in ``column`` is not null and not among the keys of target."""
    return rows.filter(F.col(column).isNotNull()).join(target.select(F.col(key).alias(column)).distinct(), column, "left_anti")
