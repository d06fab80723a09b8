from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.operators import relational as R


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_names_and_columns(spark):
    df = spark.createDataFrame([(1, 2)], ["A B ", "c"])
    assert R.clean_names(df).columns == ["a_b", "c"]
    with pytest.raises(ValueError):
        R.clean_names(spark.createDataFrame([(1, 2)], ["a b", "A_B"]))
    with pytest.raises(ValueError, match=r"\['x', 'y'\]"):
        R.expect_columns(df, ["y", "c", "x"])
    assert R.reorder(df, ["c", "z"]).columns == ["c", "A B "]


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 1, "n"), (None, 2, "m"), ("b", None, "z"), ("b", 1, "w")], "k string, o int, v string")
    assert rows(R.keep_first(df, ["k"], [F.asc_nulls_last("o")]).select("k", "v")) == [("a", "x"), ("b", "w"), (None, "n")]
    assert rows(R.keep_last(df, ["k", "missing"], ["o"]).select("k", "v")) == [("a", "y"), ("b", "w"), (None, "m")]
    assert rows(R.keep_last(df, ["k"], [F.desc_nulls_first("o")]).select("k", "v")) == [("a", "y"), ("b", "z"), (None, "m")]
    assert R.keep_first(df, ["missing"], []).count() == 6
    with pytest.raises(ValueError):
        R.keep_first(df, ["k"], [])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9)), max_size=30))
def test_keep_last_properties(spark, data):
    df = spark.createDataFrame([(k, o, i) for i, (k, o) in enumerate(data)], "k int, o int, i int")
    kept = R.keep_last(df, ["k"], ["o", "i"])
    got = rows(kept)
    want = {}
    for i, (k, o) in enumerate(data):
        want[k] = max(want.get(k, (-1, -1)), (o, i))
    assert got == sorted((k, *v) for k, v in want.items())
    ids = spark.createDataFrame([(0,), (2,)], "k int")
    assert rows(R.semi_filter(kept, ids, "k")) == rows(R.keep_last(R.semi_filter(df, ids, "k"), ["k"], ["o", "i"]))


def test_joins(spark):
    left = spark.createDataFrame([(1, "a", "l1"), (2, "b", "l2"), (3, "", "l3")], "k int, v string, w string")
    right = spark.createDataFrame([(1, "", "r1"), (2, "B", None)], "k int, v string, w string")
    out = R.coalesce_join(left, right, "k", ["v"])
    assert out.columns == ["k", "w_raw", "w_enriched", "v"]
    assert rows(out.select("k", "v")) == [(1, "a"), (2, "B"), (3, "")]
    assert rows(R.coalesce_join(left, right, "k", ["v"], compat=True).select("k", "v")) == [(1, "a"), (2, "B"), (3, None)]
    assert rows(R.overwrite(left, right, ["k"])) == [(1, "a", "r1"), (2, "B", "l2"), (3, "", "l3")]
    assert rows(R.flag_existence(left, right, ["k"], "has").select("k", "has")) == [(1, True), (2, True), (3, False)]
    dates = spark.createDataFrame([(1, "d"), (1, "d")], "k int, d string")
    assert R.backfill(left, dates, "k", "d").columns == ["k", "d", "v", "w"]
    assert R.backfill(left, dates, "k", "v") is left
    assert R.semi_filter(left, dates, "k").count() == 1


def test_text_and_union(spark):
    df = spark.createDataFrame([(" a  b ", None, 1)], "x string, y string, n int")
    once = R.normalize_text(df)
    assert rows(once) == rows(R.normalize_text(once)) == [("a b", None, 1)]
    assert rows(R.normalize_text(df, compat=True)) == [("a b", "nan", 1)]
    both = R.union_by_name([df, spark.createDataFrame([(2.5, "z")], "n double, q string")])
    assert both.columns == ["x", "y", "n", "q"] and both.count() == 2


def test_filters_and_order(spark):
    d = date(2024, 1, 2)
    good = ("A", "B", 2, 1, "A", d)
    bad = [("TBD", "B", 2, 1, "TBD", d), ("A", "A", 2, 1, "A", d), ("A", "B", 1, 1, "", d), ("A", "B", None, 1, "", d), ("A", "B", 2, 1, "A", None), ("A", "B", 2, 1, "A", date(2025, 1, 1)), ("—", "B", 2, 1, "x", d)]
    df = spark.createDataFrame([good, *bad], "team1 string, team2 string, team1_score int, team2_score int, winner string, match_date date")
    assert R.valid_matches(df, date(2024, 1, 2), date(2024, 12, 31)).count() == 1
    seq = spark.createDataFrame([(i, i == 3) for i in range(6)], "i int, s boolean")
    assert [r[0] for r in R.until_stop(seq, "i", F.col("s")).orderBy("i").collect()] == [0, 1, 2, 3]
    assert R.until_stop(seq, "i", F.lit(False)).count() == 6
    assert [r[0] for r in R.page_slice(seq, [F.col("i")], 2, 3).collect()] == [2, 3, 4] and R.page_slice(seq, [F.col("i")]).count() == 6
    assert rows(R.counts(a=seq, b=seq.limit(0))) == [("a", 6), ("b", 0)]
    assert rows(R.last_wins(seq.withColumn("k", F.lit(1)), ["k"], "s", ["i"])) == [(1, False)]
    assert rows(R.joined_text(seq.withColumn("k", F.lit(1)), ["k"], "i", ["i"], "|", "t")) == [(1, "0|1|2|3|4|5")]


def test_helper_columns_meet_no_column_of_the_frame(spark):
    """Every name that the operators use for themselves, as columns of the frame: they come back as they were."""
    names = ["rank", "rank_", "stop", "fresh", "text", "order", "__rank", "__stop", "__v"]
    df = spark.createDataFrame([(k % 2, k, *[f"{n}{k}" for n in names]) for k in range(6)], ["key", "n", *names])
    whole = {r["n"]: r for r in df.collect()}
    assert [whole[r["n"]] for r in R.keep_first(df, ["key"], [F.col("n")]).collect()] == [whole[k] for k in (0, 1)]
    assert sorted(whole[r["n"]] == r for r in R.until_stop(df, "n", F.col("n") >= 3).collect()) == [True] * 4
    other = spark.createDataFrame([(0, "new", "", None)], "n long, rank string, stop string, fresh string")
    got = {r["n"]: r for r in R.overwrite(df, other, ["n"]).select(df.columns).collect()}
    assert got[0].rank == "new" and (got[0].stop, got[0].fresh) == ("stop0", "fresh0") and all(got[k] == whole[k] for k in range(1, 6))
    assert R.joined_text(df, ["key"], "text", ["order"], "+", "__v").filter("key = 0").first()[1] == "text0+text2+text4"
