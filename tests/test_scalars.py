from datetime import date

import pytest
from pyspark.sql import functions as F

from quarry.functions import scalars as S


def one(spark, f, *values):
    kinds = ", ".join(f"c{k} " + ("bigint" if isinstance(v, int) else "string") for k, v in enumerate(values))
    return spark.createDataFrame([values], kinds).select(f(*[F.col(f"c{k}") for k in range(len(values))]).alias("x")).first()[0]


@pytest.mark.parametrize("text, want", [(None, ""), ("  a  b ", "a b"), ("a \tb", "a b"), ("", ""), ("x\x1cy", "x y")])
def test_safe_str(spark, text, want):
    assert one(spark, S.safe_str, text) == want


@pytest.mark.parametrize("text, want", [("-", None), ("—", None), ("null", None), ("", None), ("12.0", None), ("x", None), (" 7 ", 7), ("+5", 5), ("-3", -3), (None, None), ("1_0", None)])
def test_safe_int(spark, text, want):
    assert one(spark, S.safe_int, text) == want


@pytest.mark.parametrize("text, want", [("+1.5%", 1.5), ("-2.0", -2.0), ("—", None), ("5d", None), ("1e3", 1000.0), (".5", 0.5), ("a", None), ("inf", float("inf"))])
def test_safe_float(spark, text, want):
    assert one(spark, S.safe_float, text) == want


@pytest.mark.parametrize("text, want", [("12(5)", (12, 5)), ("12", (12, None)), ("12 (5)", (None, None)), (None, (None, None))])
def test_compound_stat(spark, text, want):
    assert tuple(one(spark, S.compound_stat, text)) == want


@pytest.mark.parametrize("text, want", [("3 : 2", (3, 2)), ("3:2", (3, 2)), ("3", (None, None))])
def test_duel_stat(spark, text, want):
    assert tuple(one(spark, S.duel_stat, text)) == want


@pytest.mark.parametrize("text, want", [("Results for February 14th 2026", date(2026, 2, 14)), ("results", None), ("Results for march 1st 2024", date(2024, 3, 1)), ("x", None)])
def test_headline_date(spark, text, want):
    assert one(spark, S.headline_date, text) == want


@pytest.mark.parametrize("a, b, x, y, want", [("A", "B", 2, 1, "A"), ("A", "B", 1, 2, "B"), ("A", "B", 1, 1, "")])
def test_winner(spark, a, b, x, y, want):
    assert one(spark, S.winner, a, b, x, y) == want
    assert spark.range(1).select(S.winner(F.lit(a), F.lit(b), F.lit(None).cast("bigint"), F.lit(1))).first()[0] == ""


@pytest.mark.parametrize(
    "line, want",
    [("1. T removed M", (1, "T", "removed", "M")), ("2. T 2 picked M", (2, "T 2", "picked", "M")), ("7. M was left over", (7, "", "left_over", "M")), ("foo", (None, "", "", "")), ("3. A removed B picked C", (3, "A", "removed", "B picked C"))],
)
def test_veto(spark, line, want):
    assert tuple(one(spark, S.veto, line)) == want


@pytest.mark.parametrize(
    "spans, want",
    [
        ([("CT", 8), ("T", 7), ("T", 5), ("CT", 3)], (8, 5, 3, 7, "CT")),
        ([("T", 8), ("CT", 4), ("CT", 5), ("T", 3), ("T", 9)], (5, 8, 4, 3, "T")),
        ([("T", 8), ("", 4), ("CT", None), ("T", 3)], (None, None, None, None, "")),
    ],
)
def test_half_scores(spark, spans, want):
    df = spark.createDataFrame([(spans,)], "s array<struct<side:string,rounds:bigint>>")
    assert tuple(df.select(S.half_scores(F.col("s")).alias("h")).first()[0]) == want


def test_times_and_ids(spark):
    assert one(spark, S.epoch_date, "1700000000123") == date(2023, 11, 14)
    assert one(spark, S.epoch_date, "17x") is None
    assert one(spark, S.epoch_iso, "1700000000000") == "2023-11-14T22:13:20+00:00"
    assert one(spark, S.epoch_iso, "1700000000123") == "2023-11-14T22:13:20.123000+00:00"
    assert one(spark, S.epoch_iso, "") == ""
    assert one(spark, S.canonical_id, "123.0") == "123"
    assert spark.sql("select array(10L, 9L, null, 10L) as a").select(S.roster_hash(F.col("a"))).first()[0] == "9-10-10"
    assert spark.sql("select cast(array() as array<bigint>) as a").select(S.roster_hash(F.col("a"))).first()[0] == ""


def test_coalesced(spark):
    df = spark.createDataFrame([(None, "r1"), ("", "r2"), ("nan", "r3"), ("x", "r4")], "e string, r string")
    assert [r[0] for r in df.select(S.coalesced(F.col("e"), F.col("r"))).collect()] == ["r1", "r2", "nan", "x"]
    assert [r[0] for r in df.select(S.coalesced(F.col("e"), F.col("r"), True)).collect()] == [None, "r2", "nan", "x"]
