"""Models against plain loops."""

import datetime as dt
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import model_queries
from quarry.models import asof, audit, elo, mappool, rosters, winmodel

D0 = dt.date(2020, 1, 1)


def date(k):
    return D0 + dt.timedelta(days=k)


# ratings


def season(seed, n=120, teams=9):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        a = "T0" if k % 3 == 0 else f"T{rng.randrange(teams)}"  # one team in a third of all matches
        b = rng.choice([f"T{x}" for x in range(teams) if f"T{x}" != a])
        out.append((f"m{rng.randrange(10**6)}-{k}", dt.datetime(2020, 1, 1) + dt.timedelta(days=rng.randrange(700)), a, b, rng.choice([0.0, 0.5, 1.0])))
    return out


def loop(matches, k=32.0):
    rating, out, wave, last = {}, {}, {}, {}
    for i, when, a, b, s in sorted(matches, key=lambda m: (m[1], m[0])):
        ra, rb = rating.get(a, 1500.0), rating.get(b, 1500.0)
        e = 1 / (1 + 10 ** ((rb - ra) / 400))
        rating[a], rating[b] = ra + k * (s - e), rb - k * (s - e)
        out[i] = (ra, rb, e, rating[a], rating[b])
        wave[i] = last[a] = last[b] = 1 + max(last.get(a, 0), last.get(b, 0))
    return out, wave


SCHEMA = "match_id string, when timestamp, a string, b string, score double"


@pytest.mark.parametrize("block", [None, "year"])
def test_elo_equals_a_loop(spark, block):
    rows = season(1, 40)
    odd = [(None, rows[0][1], "T1", "T2", 1.0), ("x", None, "T1", "T2", 1.0), ("y", rows[0][1], "T1", "T1", 1.0), ("z", rows[0][1], None, "T1", 0.0)]
    got = {r.match_id: r for r in elo.rate(spark.createDataFrame(rows + odd, SCHEMA), block=block).collect()}
    want, wave = loop(rows)
    assert set(got) == set(want)
    for i, w in want.items():
        r = got[i]
        assert (r.a_before, r.b_before, r.expected, r.a_after, r.b_after) == pytest.approx(w)
    # no team twice in a wave, waves in the order of each team's matches, and as few as there can be where there is one block
    for team in {r.a for r in got.values()} | {r.b for r in got.values()}:
        mine = [got[m[0]].wave for m in sorted(rows, key=lambda m: (m[1], m[0])) if team in m[2:4]]
        assert all(x < y for x, y in zip(mine, mine[1:]))
    if block is None:
        assert {i: r.wave for i, r in got.items()} == wave


def test_elo_without_matches(spark):
    assert elo.rate(spark.createDataFrame([], SCHEMA)).count() == 0


# win model


def test_fit_equals_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.3 + 1.5 * x[:, 0] - 0.7 * x[:, 1])))).astype(float)
    rows = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)] + [(None, 1.0, 1.0), (1.0, 1.0, None)], "u double, v double, y double")
    for ridge in (0.0, 5.0):
        model = winmodel.fit(rows, ["u", "v"], "y", ridge=ridge)
        xs, w = np.c_[np.ones(400), x], np.zeros(3)
        for _ in range(30):
            p = 1 / (1 + np.exp(-xs @ w))
            pull = np.array([0, ridge, ridge])
            w = w + np.linalg.solve((xs * (p * (1 - p))[:, None]).T @ xs + np.diag(pull), xs.T @ (y - p) - pull * w)
        assert model.converged and 2 < model.steps < 15 and model.weights == pytest.approx(w, abs=1e-6)
    p = 1 / (1 + np.exp(-xs @ np.array(model.weights)))
    loss = rows.dropna().agg(winmodel.log_loss(model.probability(), F.col("y"))).first()[0]
    assert loss == pytest.approx(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
    bins = {r.bin: r for r in winmodel.calibration(rows, model, "y", 5).collect()}
    for k, r in bins.items():
        mine = np.minimum(np.floor(p * 5), 4) == k
        assert (r.n, r.mean_p, r.rate) == (mine.sum(), pytest.approx(p[mine].mean()), pytest.approx(y[mine].mean()))
    assert sum(r.n for r in bins.values()) == 400


def test_fit_of_dependent_features_and_no_rows(spark):
    rows = spark.createDataFrame([(float(k % 5), k % 3 == 0) for k in range(60)], "u double, y boolean").withColumn("twice", 2 * F.col("u"))
    model = winmodel.fit(rows, ["u", "twice"], "y")
    assert model.converged and all(map(math.isfinite, model.weights))
    with pytest.raises(ValueError, match="no rows"):
        winmodel.fit(rows.limit(0), ["u"], "y")


# point in time


def events(seed, n=150):
    rng = random.Random(seed)
    return [(k, "hot" if k % 3 == 0 else rng.choice(["a", "b", None]), None if k % 29 == 0 else date(rng.randrange(200)), rng.choice([None, 1.0, 2.0, 3.5])) for k in range(n)]


@pytest.mark.parametrize("block", ["month", "week", "year"])
def test_sums_before_equal_a_loop(spark, block):
    rows = events(3)
    df = spark.createDataFrame(rows, "id long, row string, d date, v double")  # a column named as the helper is
    got = {r.id: r for r in asof.sums_before(df, ["row"], "d", {"n": F.lit(1).cast("long"), "s": F.col("v")}, block).collect()}
    assert len(got) == len(rows)
    for i, k, d, v in rows:
        before = [r for r in rows if r[1] == k and r[2] and d and r[2] < d]
        want = (None, None) if d is None else (len(before), sum(r[3] or 0 for r in before))
        assert (got[i].row, got[i].d, got[i].v, got[i].n, got[i].s) == (k, d, v, *want)


@pytest.mark.parametrize("block", ["month", "week"])
def test_join_before_equals_a_loop(spark, block):
    left, right = events(4), events(5, 60)
    schema = "id long, k string, d date, v double"
    got = asof.join_before(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], "d", {"last": F.col("v"), "of": F.col("id")}, ["id"], block).collect()
    assert len(got) == len(left)
    for r in got:
        before = [x for x in right if x[1] == r.k and x[2] and r.d and x[2] < r.d]
        best = max(before, key=lambda x: (x[2], x[0]), default=(None, None, None, None))
        assert (r.last, r.of) == (best[3], best[0])


# decayed sums


@pytest.mark.parametrize(("block", "half_life"), [("month", 30.0), ("quarter", 90.0), ("year", 10.0)])
def test_decayed_sums_equal_the_quadratic_formula(spark, block, half_life):
    rng = random.Random(6)
    rows = [(k, "hot" if k % 3 == 0 else rng.choice("ab"), None if k == 7 else date(rng.randrange(3000)), rng.choice([None, 1.0, 2.0])) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, k string, d date, v double")
    got = {r.id: r for r in mappool.decayed_before(df, ["k"], "d", {"n": F.lit(1), "s": F.col("v")}, half_life, block).collect()}
    for i, k, d, _ in rows:
        before = [(2 ** (-(d - r[2]).days / half_life), r[3] or 0) for r in rows if r[1] == k and r[2] and d and r[2] < d]
        if d is None:
            assert got[i].n is None
        else:
            assert got[i].n == pytest.approx(sum(w for w, _ in before), abs=1e-9) and got[i].s == pytest.approx(sum(w * v for w, v in before), abs=1e-9)


# rosters


def lineups(seed):
    rng = random.Random(seed)
    out = []
    for m in range(120):
        team, d = ("hot" if m % 3 else rng.choice("ab")), date(rng.randrange(150))
        out += [(team, d, m, p) for p in rng.sample("uvwxyz", rng.randint(1, 5))]
    return out + [("hot", date(k), 1000 + k, "always") for k in range(0, 150, 5)] + [(None, date(1), 1, "u"), ("a", None, 2, "u"), ("a", date(2), 3, None)] + out[:20]


def islands(rows):
    rows = {r for r in rows if None not in r}
    out = []
    for team in {r[0] for r in rows}:
        games = sorted({(r[1], r[2]) for r in rows if r[0] == team})
        for player in {r[3] for r in rows if r[0] == team}:
            run = []
            for g in [*games, None]:
                if g and (team, *g, player) in rows:
                    run.append(g[0])
                elif run:
                    out.append((team, player, run[0], run[-1], len(run)))
                    run = []
    return sorted(out)


@pytest.mark.parametrize("block", ["month", "week", "year"])
def test_tenures_equal_a_loop(spark, block):
    rows = lineups(7)
    got = rosters.tenures(spark.createDataFrame(rows, "team string, when date, match long, player string"), block=block)
    # a team's matches without the player count, so the lineups of all players are one table
    assert sorted((r.team, r.player, date(r.start - (D0 - dt.date(1970, 1, 1)).days), date(r.stop - (D0 - dt.date(1970, 1, 1)).days), r.n_matches) for r in got.collect()) == islands(rows)


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice("ab"), s, s + rng.choice([0, 0, 1, 2, 5, 30, 900])) for k, s in enumerate(rng.randrange(-50, 1000) for _ in range(150))]
    rows += [(900, "a", -500, 5000), (901, "b", 17, 17), (902, "a", 9, 3)]
    df = spark.createDataFrame(rows, "id long, k string, start long, stop long")
    got = [(r.l.id, r.r.id) for r in rosters.overlaps(df, df, ["k"], F.col("l.id") < F.col("r.id")).collect()]
    want = [(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3] and x[2] <= x[3] and y[2] <= y[3]]
    assert sorted(got) == sorted(want)
    assert rosters.overlaps(df.limit(0), df, ["k"], F.lit(True)).count() == 0


# audit


def test_audit(spark):
    rng = random.Random(9)
    rows = [(None if k == 5 else date(k % 40), rng.choice([None, "x", "y", "y", f"r{k}"]), rng.choice([None, float(rng.randrange(2000))]), k) for k in range(4000)]
    df = spark.createDataFrame(rows, "d date, name string, v double, k long")
    days = audit.summarize(df, "d").cache()
    assert days.count() == 41 * 3
    whole = {r.column: r for r in audit.report(audit.merged(days)).collect()}
    once = {r.column: r for r in audit.report(audit.merged(audit.summarize(df.withColumn("d", F.lit(None).cast("date")), "d"))).collect()}
    for c, at in (("name", 1), ("v", 2), ("k", 3)):
        values = [r[at] for r in rows if r[at] is not None]
        for got in (whole[c], once[c]):
            assert (got.rows, got.nulls) == (len(rows), len(rows) - len(values))
            assert got.n_distinct == pytest.approx(len(set(values)), rel=0.05)
            if c != "name":
                assert (got.low, got.high) == (min(values), max(values))
                for q, v in zip((0.25, 0.5, 0.75), got.quantiles):
                    below = sum(x < v for x in values) / len(values), sum(x <= v for x in values) / len(values)
                    assert below[0] - 0.02 <= q <= below[1] + 0.02
    assert whole["name"].n_distinct == once["name"].n_distinct  # a merge of parts is the whole
    top = {x["item"]: x["count"] for x in once["name"].frequent}
    assert abs(top["y"] - sum(r[1] == "y" for r in rows)) <= len(rows) / 1000 * 4
    assert audit.repeated_keys(df, ["d"]).count() == 40
    assert audit.broken_references(df, "name", spark.createDataFrame([("x",), ("y",)], "n string"), "n").count() == sum(r[1] not in (None, "x", "y") for r in rows)


def test_elo_in_parts_equals_a_loop(spark):
    """Rounds that send ratings between parts rate as a loop does, to the last bit, wherever teams are, and also by blocks."""
    rows = season(7, 45, 13)
    frame = spark.createDataFrame(rows + [("null", rows[0][1], "T1", "T2", None)], SCHEMA).filter("score is not null")
    want, wave = loop(rows)
    for parts, block in ((1, None), (3, None), (5, "quarter")):
        got = {r.match_id: r for r in elo.rate(frame, block=block, parts=parts).collect()}
        assert {i: (r.a_before, r.b_before, r.expected, r.a_after) for i, r in got.items()} == {i: w[:4] for i, w in want.items()}
        assert {i: r.when for i, r in got.items()} == {m[0]: m[1] for m in rows}
        if block is None:
            assert {i: r.wave for i, r in got.items()} == wave


def test_elo_rounds_are_few_where_teams_meet_their_like(spark, monkeypatch):
    """A round for each time that a chain of matches changes part, not one for each match of a team."""
    rounds = []
    monkeypatch.setattr(elo, "_round", lambda *x, f=elo._round: rounds.append(1) or f(*x))
    day = [dt.datetime(2020, 1, 1) + dt.timedelta(days=k) for k in range(41)]
    near = [(f"{t}{k}", day[k], f"{t}{k % 3}", f"{t}{(k + 1) % 3}", 1.0) for t in "AZ" for k in range(40)] + [("x", day[40], "A1", "Z1", 0.0)]
    got = elo.rate(spark.createDataFrame(near, SCHEMA), block=None, parts=2)
    assert {r.match_id: r.a_after for r in got.collect()} == {i: w[3] for i, w in loop(near)[0].items()}
    assert got.agg(F.max("wave")).first()[0] > 30 and len(rounds) <= 3


def test_win_model_reads_what_the_ratings_wrote(spark, monkeypatch):
    """A step of the fit scans a table: no join of matches with their ratings, no copy of rows."""
    plans = []
    monkeypatch.setattr(winmodel, "fit", lambda rows, *x, f=winmodel.fit: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or f(rows, *x))
    assert model_queries.QUERIES["win_model"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(plans) == 1 and "FileScan parquet" in plans[0] and not any(x in plans[0] for x in ("Join", "Exchange", "ExistingRDD"))


def test_tenures_of_the_same_days_are_one_row_of_the_join(spark, tmp_path, monkeypatch):
    """A player in and out of a team within a day has many tenures of that day, whose pairs are counted and not made."""
    day = [dt.datetime(1996, 1, 31), dt.datetime(1996, 2, 1)]
    orders = [(k, 20 * (k % 3), day[k >= 12]) for k in range(24)]  # one team
    lines = [(k, p) for k in range(24) for p in (1, 2, 3) if k % (p + 1) or k in (0, 23)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    met = []
    monkeypatch.setattr(rosters, "overlaps", lambda left, *x, f=rosters.overlaps: met.append(left) or f(left, *x))
    sql = model_queries.SQL["tenure_overlaps"]
    for t in ("orders", "lineitem"):
        sql = sql.replace(f"FROM {t} ", f"FROM '{tmp_path}/{t}.parquet/*.parquet' ").replace(f"JOIN {t} ", f"JOIN '{tmp_path}/{t}.parquet/*.parquet' ")
    want = duckdb.sql(sql).fetchall()
    got = model_queries.QUERIES["tenure_overlaps"](spark, str(tmp_path)).select("team", "player", "mate", "n_overlaps", "days").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 3
    keys = [tuple(r[c] for c in ("team", "player", "start", "stop")) for r in met[0].collect()]
    assert len(keys) == len(set(keys)) < model_queries._tenures(spark, str(tmp_path)).count()


def test_tenures_count_matches_without_known_players(spark):
    """At the end of a block, too: they end a run, and the next block's numbers go on after them."""
    rows = [("a", date(30), 1, "x"), ("a", date(30), 2, None), ("a", date(31), 3, "x"), ("a", date(32), 4, "x"), ("a", date(70), 5, "x"), ("a", date(70), 6, "y"), ("a", date(95), 7, None), ("a", date(100), 8, "y")]
    got = rosters.tenures(spark.createDataFrame(rows, "team string, when date, match long, player string"))
    day = lambda k: (date(k) - dt.date(1970, 1, 1)).days
    assert sorted(map(tuple, got.collect())) == sorted([("a", "x", day(30), day(30), 1), ("a", "x", day(31), day(70), 3), ("a", "y", day(70), day(70), 1), ("a", "y", day(100), day(100), 1)])
