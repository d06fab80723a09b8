"""Registered queries of the models, with orders as matches and line items as lineups, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .models import asof, audit, elo, mappool, rosters, winmodel
from .session import settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_RIVAL = "o_custkey + 1 + o_orderkey % 50"
_SCORE = f"CASE WHEN 3 * (o_custkey % 10 - ({_RIVAL}) % 10) + o_orderkey * 7919 % 41 - 20 > 0 THEN 1.0 ELSE 0.0 END"
#: a meets one of the 50 teams after it; the better last digit tends to win
_MATCHES = f"SELECT o_orderkey AS match_id, o_orderdate AS ts, o_custkey AS a, {_RIVAL} AS b, cast({_SCORE} AS double) AS score FROM orders"

_ELO = f"""
m AS ({_MATCHES}),
legs AS (SELECT match_id, ts, a AS team, b AS rival, score, 'a' AS side FROM m UNION ALL SELECT match_id, ts, b, a, 1 - score, 'b' FROM m),
num AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY ts, match_id) AS idx FROM legs),
nx AS (SELECT x.*, y.idx AS rival_idx FROM num x JOIN num y ON x.match_id = y.match_id AND x.side <> y.side),
s AS (SELECT DISTINCT team, cast(1500 AS double) AS rating, cast(0 AS bigint) AS done, cast(NULL AS bigint) AS match_id, '' AS side, cast(0 AS double) AS was, cast(0 AS double) AS e FROM num
  UNION ALL
  SELECT team, CASE WHEN ready THEN rating + 32 * (score - p) ELSE rating END, done + cast(ready AS bigint), CASE WHEN ready THEN played END, leg, rating, p
  FROM (SELECT s.team, s.rating, s.done, n.score, n.match_id AS played, n.side AS leg, o.done + 1 = n.rival_idx AS ready, 1 / (1 + pow(10, (o.rating - s.rating) / 400)) AS p
    FROM s JOIN nx n ON n.team = s.team AND n.idx = s.done + 1 JOIN s o ON o.team = n.rival)),
elo AS (SELECT x.match_id, x.team AS a, y.team AS b, x.was AS a_before, y.was AS b_before, x.e AS expected, x.rating AS a_after, y.rating AS b_after FROM s x JOIN s y ON x.match_id = y.match_id WHERE x.side = 'a' AND y.side = 'b')
"""


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderkey").alias("match_id"), F.col("o_orderdate").alias("when"), F.col("o_custkey").alias("a"), F.expr(_RIVAL).alias("b"), F.expr(_SCORE).cast("double").alias("score"))


@_query(f"""
WITH RECURSIVE {_ELO}
SELECT match_id, a, b, round(a_before, 6) AS a_before, round(b_before, 6) AS b_before, round(expected, 6) AS expected, round(a_after, 6) AS a_after, round(b_after, 6) AS b_after FROM elo
""")
def elo_ratings(spark, sf_dir):
    rated = elo.rate(_matches(spark, sf_dir), block=None)
    return rated.select("match_id", "a", "b", *[F.round(c, 6).alias(c) for c in ("a_before", "b_before", "expected", "a_after", "b_after")])


@_query(f"""
WITH RECURSIVE {_ELO},
x AS (SELECT ts, score AS y, (a_before - b_before) / 400 AS x FROM elo JOIN m ON m.match_id = elo.match_id),
fit AS (SELECT 0 AS step, cast(0 AS double) AS w0, cast(0 AS double) AS w1
  UNION ALL
  SELECT step + 1, w0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), w1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  FROM (SELECT step, w0, w1, sum(y - p) AS g0, sum(x * (y - p)) AS g1, sum(p * (1 - p)) AS h00, sum(x * p * (1 - p)) AS h01, sum(x * x * p * (1 - p)) AS h11
    FROM (SELECT *, 1 / (1 + exp(-(w0 + w1 * x))) AS p FROM fit, x WHERE ts < timestamp '1999-01-01' AND step < 12) GROUP BY step, w0, w1)),
w AS (SELECT w0, w1 FROM fit WHERE step = 12),
later AS (SELECT y, 1 / (1 + exp(-(w0 + w1 * x))) AS p FROM x, w WHERE ts >= timestamp '1999-01-01'),
loss AS (SELECT -avg(y * ln(p) + (1 - y) * ln(1 - p)) AS log_loss FROM later)
SELECT cast(least(floor(p * 10), 9) AS integer) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate, round(any_value(log_loss), 6) AS log_loss, round(any_value(w0), 6) AS intercept, round(any_value(w1), 6) AS weight
FROM later, loss, w GROUP BY 1
""")
def win_model(spark, sf_dir):
    """Fitted on ratings before matches up to 1998, judged on later ones."""
    # a table that rate has written, so each step reads the columns it needs
    rows = elo.rate(_matches(spark, sf_dir), block=None).select("when", "score", ((F.col("a_before") - F.col("b_before")) / 400).alias("gap"))
    rows = rows.withColumn("late", F.col("when") >= F.lit("1999-01-01").cast("timestamp_ntz"))
    model = winmodel.fit(rows.filter("not late"), ["gap"], "score")
    late = rows.filter("late")
    loss = late.agg(F.round(winmodel.log_loss(model.probability(), F.col("score")), 6).alias("log_loss"))
    bins = winmodel.calibration(late, model, "score")
    told = [F.lit(round(w, 6)).alias(n) for w, n in zip(model.weights, ("intercept", "weight"))]
    return bins.join(F.broadcast(loss)).select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("rate", 6).alias("rate"), "log_loss", *told)


@_query("""
WITH o AS (SELECT o_orderkey, o_custkey % 100 AS team, cast(o_orderdate AS date) AS d, o_totalprice AS price, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS won FROM orders)
SELECT o_orderkey, (SELECT count(*) FROM o p WHERE p.team = o.team AND p.d < o.d) AS games, coalesce((SELECT sum(won) FROM o p WHERE p.team = o.team AND p.d < o.d), 0) AS wins,
  (SELECT arg_max(p.price, (p.d, p.o_orderkey)) FROM o p WHERE p.team = o.team AND p.d < o.d) AS last_price, (SELECT o.d - max(p.d) FROM o p WHERE p.team = o.team AND p.d < o.d) AS days_since
FROM o
""")
def team_form_asof(spark, sf_dir):
    """What was known of a team before the day of each of its matches."""
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("team"), F.col("o_orderdate").alias("d"), F.col("o_totalprice").alias("price"), (F.col("o_orderstatus") == "F").cast("long").alias("won"))
    out = asof.sums_before(rows, ["team"], "d", {"games": F.lit(1).cast("long"), "wins": F.col("won")})
    out = asof.join_before(out, rows, ["team"], "d", {"last_price": F.col("price"), "last_day": asof.day("d")}, ["o_orderkey"])
    return out.select("o_orderkey", "games", "wins", "last_price", (asof.day("d") - F.col("last_day")).cast("long").alias("days_since"))


@_query("""
WITH l AS (SELECT *, date_diff('day', date '1970-01-01', cast(l_shipdate AS date)) AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, l_suppkey, coalesce(sum(l_quantity) OVER w, 0) AS quantity_before, count(*) OVER w AS lines_before, round(sum(l_quantity) OVER w / count(*) OVER w, 6) AS mean_before
FROM l WINDOW w AS (PARTITION BY l_suppkey ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def player_form_asof(spark, sf_dir):
    """Sums of a player's earlier days for each of its rows."""
    rows = asof.sums_before(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_shipdate", {"quantity_before": F.col("l_quantity"), "lines_before": F.lit(1).cast("long")})
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "quantity_before", "lines_before", F.round(F.expr("try_divide(quantity_before, lines_before)"), 6).alias("mean_before"))


_TENURES = """
l AS (SELECT DISTINCT o_custkey % 20 AS team, cast(o_orderdate AS date) AS d, o_orderkey AS m, l_suppkey % 15 AS player FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT team, m, row_number() OVER (PARTITION BY team ORDER BY d, m) AS seq FROM (SELECT DISTINCT team, d, m FROM l)),
r AS (SELECT l.*, seq - row_number() OVER (PARTITION BY l.team, player ORDER BY seq) AS island FROM l JOIN n ON n.team = l.team AND n.m = l.m),
t AS (SELECT team, player, min(d) AS start, max(d) AS stop, count(*) AS n_matches FROM r GROUP BY team, player, island)
"""


def _tenures(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 15).alias("player"))
    games = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("match"), F.col("o_orderdate").alias("when"), (F.col("o_custkey") % 20).alias("team"))
    return rosters.tenures(lines.join(games, F.col("l_orderkey") == F.col("match")))


@_query(f"WITH {_TENURES} SELECT * FROM t")
def roster_tenures(spark, sf_dir):
    return _tenures(spark, sf_dir).withColumns({c: F.date_from_unix_date(c) for c in ("start", "stop")})


@_query(f"""
WITH {_TENURES}
SELECT l.team, l.player, r.player AS mate, count(*) AS n_overlaps, cast(sum(least(l.stop, r.stop) - greatest(l.start, r.start) + 1) AS bigint) AS days
FROM t l JOIN t r ON l.team = r.team AND l.player < r.player AND l.start <= r.stop AND r.start <= l.stop GROUP BY ALL
""")
def tenure_overlaps(spark, sf_dir):
    """Who played beside whom: pairs of tenures of one team that have a day in common. Tenures of the same days go as one with their number."""
    runs = settled(_tenures(spark, sf_dir).groupBy("team", "player", "start", "stop").agg(F.count("*").alias("n")))
    pairs = rosters.overlaps(runs, runs, ["team"], F.col("l.player") < F.col("r.player"))
    days, n = F.least("l.stop", "r.stop") - F.greatest("l.start", "r.start") + 1, F.col("l.n") * F.col("r.n")
    return pairs.groupBy("l.team", "l.player", F.col("r.player").alias("mate")).agg(F.sum(n).alias("n_overlaps"), F.sum(n * days).alias("days"))


@_query("""
WITH o AS (SELECT o_orderkey, o_custkey % 50 AS team, o_orderpriority AS map, cast(o_orderdate AS date) AS d, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS won FROM orders),
s AS (SELECT o.o_orderkey, sum(pow(2, -(o.d - p.d) / 90.0)) AS games, sum(p.won * pow(2, -(o.d - p.d) / 90.0)) AS wins FROM o JOIN o p ON p.team = o.team AND p.map = o.map AND p.d < o.d GROUP BY o.o_orderkey)
SELECT o.o_orderkey, round(coalesce(games, 0), 6) AS games, round(coalesce(wins, 0), 6) AS wins, round(wins / games, 6) AS rate FROM o LEFT JOIN s ON s.o_orderkey = o.o_orderkey
""")
def map_pool_decay(spark, sf_dir):
    """A team's games and wins on a map before each match, half as much for each 90 days ago."""
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("team"), F.col("o_orderpriority").alias("map"), F.col("o_orderdate").alias("d"), (F.col("o_orderstatus") == "F").cast("double").alias("won"))
    out = mappool.decayed_before(rows, ["team", "map"], "d", {"games": F.lit(1.0), "wins": F.col("won")})
    return out.select("o_orderkey", F.round("games", 6).alias("games"), F.round("wins", 6).alias("wins"), F.round(F.expr("try_divide(wins, games)"), 6).alias("rate"))


_AUDITED = {"o_custkey": True, "o_totalprice": True, "o_orderpriority": False, "o_orderstatus": False}


def _audit_sql(column: str, number: bool) -> str:
    ends = [f"cast({f}({column}) AS double)" if number else "cast(NULL AS double)" for f in ("min", "max")]
    return f"SELECT '{column}' AS name, count(*) AS n_rows, count(*) - count({column}) AS nulls, {ends[0]} AS low, {ends[1]} AS high, true AS distinct_holds, {'true' if number else 'cast(NULL AS boolean)'} AS median_holds, {'cast(NULL AS boolean)' if number else 'true'} AS top_holds FROM orders"


@_query(" UNION ALL ".join(_audit_sql(c, number) for c, number in _AUDITED.items()))
def data_audit(spark, sf_dir):
    """Sketches of each day of orders, merged, and whether what they say is within their bounds of exact counts."""
    orders = _t(spark, sf_dir, "orders")
    told = audit.report(audit.merged(audit.summarize(orders, "o_orderdate", list(_AUDITED))), [0.5], 1)
    told = {r["column"]: r for r in told.collect()}  # a row a column
    of = []
    for c, number in _AUDITED.items():
        r = told[c]
        off = F.abs(F.count_distinct(c) / r["n_distinct"] - 1) <= 4 * 1.04 / 2 ** (audit.LG_CONFIG / 2)
        if number:
            median, n = F.lit(r["quantiles"][0]), F.count(c)
            holds, top = (F.count_if(F.col(c) < median) / n <= 0.52) & (F.count_if(F.col(c) <= median) / n >= 0.48), F.lit(None).cast("boolean")
        else:
            best = r["frequent"][0]
            holds, top = F.lit(None).cast("boolean"), F.abs(F.count_if(F.col(c) == best["item"]) - best["count"]) <= F.count("*") / audit.ITEMS
        ends = [F.lit(r[e]).cast("double").alias(e) for e in ("low", "high")]
        of.append(F.struct(F.lit(c).alias("name"), F.lit(r["rows"]).alias("n_rows"), F.lit(r["nulls"]).alias("nulls"), *ends, off.alias("distinct_holds"), holds.alias("median_holds"), top.alias("top_holds")))
    return orders.agg(F.array(*of).alias("of")).select(F.inline("of"))


@_query("""
SELECT (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS repeated_keys,
  (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS lines_without_order, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS orders_without_line
""")
def audit_references(spark, sf_dir):
    lines, orders = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders")
    parts = {
        "repeated_keys": audit.repeated_keys(lines, ["l_orderkey", "l_linenumber"]),
        "lines_without_order": audit.broken_references(lines, "l_orderkey", orders, "o_orderkey"),
        "orders_without_line": audit.broken_references(orders, "o_orderkey", lines, "l_orderkey"),
    }
    counts = [df.agg(F.count("*").alias(n)) for n, df in parts.items()]
    return counts[0].join(counts[1]).join(counts[2])  # one row each
