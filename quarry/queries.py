"""Registered queries of the library's own operators, on the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import extract, relational as R

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


def _date(c: str):
    return F.col(c).cast("date")


@_query("""
SELECT o_custkey, o_orderkey, cast(o_orderdate AS date) AS o_orderdate, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders WHERE o_orderdate >= timestamp '1997-06-01') WHERE rn = 1
""")
def keep_first_by_date(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit("1997-06-01").cast("timestamp_ntz"))
    return R.keep_first(rows, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", _date("o_orderdate").alias("o_orderdate"), "o_totalprice")


@_query("SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, arg_min(lang, doc_id) AS lang FROM documents GROUP BY text")
def keep_first_arrival(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return R.keep_first(rows, ["text"], [F.col("doc_id")]).select("doc_id", "source", "lang")


@_query("""
WITH o AS (SELECT *, CASE WHEN o_orderpriority NOT LIKE '4%' THEN o_orderdate END AS d FROM orders)
SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY d DESC NULLS FIRST, o_orderstatus DESC, o_orderkey DESC) AS rn FROM o) WHERE rn = 1
""")
def keep_last_nulls_win(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").withColumn("d", F.when(~F.col("o_orderpriority").startswith("4"), F.col("o_orderdate")))
    return R.keep_last(rows, ["o_custkey"], [F.desc_nulls_first("d"), F.desc("o_orderstatus"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@_query("""
SELECT l_orderkey, cast(l_linenumber AS bigint) AS l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_shipdate DESC, l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1
""")
def keep_last_composite(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    kept = R.keep_last(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity"])
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@_query("SELECT DISTINCT text, lang FROM documents")
def full_distinct(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("text", "lang").distinct()


@_query("""
SELECT l.l_orderkey, d.o_orderdate, cast(l.l_linenumber AS bigint) AS l_linenumber, l.l_partkey, l.l_quantity
FROM lineitem l LEFT JOIN (SELECT DISTINCT o_orderkey, cast(o_orderdate AS date) AS o_orderdate FROM orders) d ON l.l_orderkey = d.o_orderkey
""")
def distinct_lookup_backfill(spark, sf_dir):
    lookup = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), _date("o_orderdate").alias("o_orderdate"))
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", "l_quantity")
    return R.backfill(rows, lookup, "l_orderkey", "o_orderdate")


@_query("SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem l WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o_orderstatus = 'F')")
def semi_filter(spark, sf_dir):
    ids = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.semi_filter(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity"), ids, "l_orderkey")


_COALESCE = """
WITH l AS (SELECT * FROM (SELECT l_orderkey AS k, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS flag, l_linestatus AS status,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS rn FROM lineitem) WHERE rn = 1),
o AS (SELECT o_orderkey AS k, o_orderstatus AS flag, o_orderpriority AS status FROM orders)
SELECT o.k, {pick} AS flag, o.status AS status_raw, l.status AS status_enriched FROM o LEFT JOIN l ON o.k = l.k
"""


def _coalesce(spark, sf_dir, compat):
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.col("l_linestatus").alias("status"))
    first = R.keep_first(rows, ["k"], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "status")])
    right = first.select("k", F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("flag"), "status")
    left = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("flag"), F.col("o_orderpriority").alias("status"))
    return R.coalesce_join(left, right, "k", ["flag"], compat=compat).select("k", "flag", "status_raw", "status_enriched")


@_query(_COALESCE.format(pick="coalesce(nullif(l.flag, ''), o.flag)"))
def coalesce_join(spark, sf_dir):
    return _coalesce(spark, sf_dir, False)


@_query(_COALESCE.format(pick="CASE WHEN l.flag IS NULL OR l.flag <> '' THEN l.flag ELSE o.flag END"))
def coalesce_join_compat(spark, sf_dir):
    return _coalesce(spark, sf_dir, True)


@_query("SELECT p_partkey, p_name, EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l_returnflag = 'R') AS returned FROM part p")
def existence_flag(spark, sf_dir):
    returned = _t(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return R.flag_existence(_t(spark, sf_dir, "part").select("p_partkey", "p_name"), returned, ["p_partkey"], "returned")


@_query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def last_wins_map(spark, sf_dir):
    return R.last_wins(_t(spark, sf_dir, "events"), ["user_id", "event_type"], "value", ["ts", "event_id"])


@_query("""
SELECT c_custkey AS key, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment, 'customer' AS source_dir FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, 'supplier' FROM supplier
""")
def union_missing_cols(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("source_dir"))
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"), F.lit("supplier").alias("source_dir"))
    return R.union_by_name([c, s])


@_query("SELECT l_orderkey, string_agg(cast(l_partkey AS varchar), '-' ORDER BY l_partkey) AS parts FROM lineitem GROUP BY 1")
def roster_hash(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(S.roster_hash(F.collect_list("l_partkey")).alias("parts"))


@_query("SELECT conv_id, string_agg(role, ' | ' ORDER BY turn, role) AS roles FROM conversations GROUP BY 1")
def ordered_string_agg(spark, sf_dir):
    return R.joined_text(_t(spark, sf_dir, "conversations"), ["conv_id"], "role", ["turn", "role"], " | ", "roles")


@_query("SELECT cast(min(o_orderdate) AS date) AS first, cast(max(o_orderdate) AS date) AS last, count(*) AS rows FROM orders")
def min_max_count(spark, sf_dir):
    return R.date_range(_t(spark, sf_dir, "orders").select(_date("o_orderdate").alias("d")), "d")


@_query("SELECT 'orders' AS relation, count(*) AS rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'events', count(*) FROM events")
def row_counts(spark, sf_dir):
    return R.counts(**{n: _t(spark, sf_dir, n) for n in ("orders", "lineitem", "documents", "events")})


@_query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def normalize_text(spark, sf_dir):
    return R.normalize_text(_t(spark, sf_dir, "documents").select("doc_id", "text"))


@_query(r"SELECT page_id, try_cast(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS bigint) AS number, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref FROM pages")
def regex_id(spark, sf_dir):
    url = F.col("url")
    return _t(spark, sf_dir, "pages").select("page_id", S.first_int(url, r"/([0-9]+)").alias("number"), S.first_text(url, r"[?&]ref=([^&#]*)").alias("ref"))


@_query(r"""
WITH e AS (SELECT event_id, value, try_cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) AS k FROM events)
SELECT event_id, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN k WHEN k % 4 = 2 THEN NULL ELSE -k END AS as_int,
  CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN cast(k AS double) WHEN k % 4 = 2 THEN value ELSE cast(-k AS double) END AS as_float FROM e
""")
def safe_number(spark, sf_dir):
    k = S.first_int(F.col("props"), "([0-9]+)")
    kinds = F.when(k % 4 == 0, F.lit(" — ")).when(k % 4 == 1, F.concat(F.lit(" +"), k.cast("string"), F.lit(" "))).when(k % 4 == 2, F.concat(F.lit("+"), F.col("value").cast("string"), F.lit("%"))).otherwise(F.concat(F.lit("-"), k.cast("string")))
    return _t(spark, sf_dir, "events").select("event_id", kinds.alias("t")).select("event_id", S.safe_int(F.col("t")).alias("as_int"), S.safe_float(F.col("t")).alias("as_float"))


@_query(r"""
WITH e AS (SELECT event_id, user_id, try_cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) AS k FROM events)
SELECT event_id, user_id AS main, CASE WHEN k % 2 = 0 THEN k END AS inner_part, CASE WHEN k % 3 > 0 THEN user_id END AS won, CASE WHEN k % 3 > 0 THEN k END AS lost FROM e
""")
def compound_stat(spark, sf_dir):
    k, u = S.first_int(F.col("props"), "([0-9]+)"), F.col("user_id").cast("string")
    a = F.when(k % 2 == 0, F.concat(u, F.lit("("), k.cast("string"), F.lit(")"))).otherwise(u)
    b = F.when(k % 3 > 0, F.concat(u, F.lit(" : "), k.cast("string"))).otherwise(u)
    out = _t(spark, sf_dir, "events").select("event_id", S.compound_stat(a).alias("c"), S.duel_stat(b).alias("d"))
    return out.select("event_id", F.col("c.main").alias("main"), F.col("c.inner").alias("inner_part"), "d.won", "d.lost")


@_query(r"""
SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN NULL ELSE cast(p_size AS bigint) END AS step_number, CASE WHEN p_size % 4 < 2 THEN p_name ELSE '' END AS team_name,
  CASE p_size % 4 WHEN 0 THEN 'removed' WHEN 1 THEN 'picked' WHEN 2 THEN 'left_over' ELSE '' END AS action, CASE WHEN p_size % 4 = 3 THEN '' ELSE p_brand END AS map_name FROM part
""")
def veto_parse(spark, sf_dir):
    n, kind = F.col("p_size").cast("string"), F.col("p_size") % 4
    line = F.when(kind == 0, F.concat(n, F.lit(". "), "p_name", F.lit(" removed "), "p_brand")).when(kind == 1, F.concat(n, F.lit(". "), "p_name", F.lit(" picked "), "p_brand"))
    line = line.when(kind == 2, F.concat(n, F.lit(". "), "p_brand", F.lit(" was left over"))).otherwise(F.col("p_name"))
    return _t(spark, sf_dir, "part").select("p_partkey", S.veto(line).alias("v")).select("p_partkey", "v.*")


@_query("SELECT o_orderkey, cast(o_orderdate AS date) AS match_date FROM orders")
def headline_date(spark, sf_dir):
    d = F.dayofmonth("o_orderdate")
    suffix = F.when(d.isin(11, 12, 13), "th").when(d % 10 == 1, "st").when(d % 10 == 2, "nd").when(d % 10 == 3, "rd").otherwise("th")
    text = F.concat(F.lit("Results for "), F.date_format("o_orderdate", "MMMM "), d.cast("string"), suffix, F.date_format("o_orderdate", " yyyy"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", S.headline_date(text).alias("match_date"))


@_query("SELECT event_id, cast(ts AS date) AS d, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') AS seconds FROM events")
def epoch_to_date(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    return _t(spark, sf_dir, "events").select("event_id", S.epoch_date(ms).alias("d"), F.substring(S.epoch_iso(ms), 1, 19).alias("seconds"))


@_query("SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_partkey > l_suppkey THEN 'part' WHEN l_suppkey > l_partkey THEN 'supplier' ELSE '' END AS winner FROM lineitem")
def winner(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", S.winner(F.lit("part"), F.lit("supplier"), F.col("l_partkey"), F.col("l_suppkey")).alias("winner"))


@_query("""
WITH r AS (SELECT l_orderkey, cast(l_quantity AS bigint) AS q, CASE WHEN l_linestatus = 'O' THEN 'CT' ELSE 'T' END AS side,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_linestatus) AS rn FROM lineitem),
p AS (SELECT l_orderkey, count(*) AS n, max(q) FILTER (rn = 1) AS a, max(q) FILTER (rn = 2) AS b, max(q) FILTER (rn = 3) AS c, max(q) FILTER (rn = 4) AS d, max(side) FILTER (rn = 1) AS s FROM r GROUP BY 1)
SELECT l_orderkey, CASE WHEN n >= 4 THEN CASE WHEN s = 'CT' THEN a ELSE c END END AS team1_ct_rounds, CASE WHEN n >= 4 THEN CASE WHEN s = 'CT' THEN c ELSE a END END AS team1_t_rounds,
  CASE WHEN n >= 4 THEN CASE WHEN s = 'CT' THEN d ELSE b END END AS team2_ct_rounds, CASE WHEN n >= 4 THEN CASE WHEN s = 'CT' THEN b ELSE d END END AS team2_t_rounds,
  CASE WHEN n >= 4 THEN s ELSE '' END AS team1_starting_side FROM p
""")
def half_scores(spark, sf_dir):
    span = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("rounds"), F.when(F.col("l_linestatus") == "O", "CT").otherwise("T").alias("side"))
    rows = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    return rows.select("l_orderkey", S.half_scores(F.col("spans")).alias("h")).select("l_orderkey", "h.*")


@_query("SELECT o_orderkey, greatest(0, least(365, date_diff('day', date '1998-01-01', cast(o_orderdate AS date)))) AS covered FROM orders")
def date_diff_clamp(spark, sf_dir):
    days = F.datediff(_date("o_orderdate"), F.lit("1998-01-01").cast("date")).cast("bigint")
    return _t(spark, sf_dir, "orders").select("o_orderkey", S.clamped(days, F.lit(0).cast("bigint"), F.lit(365).cast("bigint")).alias("covered"))


@_query(r"""
WITH p AS (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN '/p/' || page_id ELSE '' END AS href FROM pages)
SELECT page_id, CASE WHEN href = '' THEN 'https://www.example.org/stats/' || page_id WHEN starts_with(href, 'http') THEN href ELSE 'https://www.example.org' || href END AS address FROM p
""")
def url_assembly(spark, sf_dir):
    i = F.col("page_id").cast("string")
    href = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("/p/"), i)).otherwise(F.lit(""))
    return _t(spark, sf_dir, "pages").select("page_id", S.absolute_url(href, "https://www.example.org", F.concat(F.lit("https://www.example.org/stats/"), i)).alias("address"))


@_query(r"SELECT doc_id, cast(i AS bigint) AS word_no, w AS word FROM (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM documents))")
def posexplode_ordinal(spark, sf_dir):
    words = F.split(S.normalized(F.col("text")), " ", -1)
    return _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(words).alias("i", "word")).select("doc_id", (F.col("i") + 1).cast("bigint").alias("word_no"), "word")


@_query("SELECT cast(o_orderdate AS date) AS o_orderdate, cast(o_orderkey AS varchar) AS key, o_totalprice FROM orders ORDER BY 1, 2 LIMIT 50 OFFSET 20")
def offset_limit(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(_date("o_orderdate").alias("o_orderdate"), F.col("o_orderkey").cast("string").alias("key"), "o_totalprice")
    return R.page_slice(rows, [F.asc_nulls_last("o_orderdate"), F.asc_nulls_last("key")], 20, 50)


@_query("""
WITH d AS (SELECT cast(ts AS date) AS event_day, count(*) AS n FROM events GROUP BY 1), s AS (SELECT min(event_day) AS stop_at FROM d WHERE n < (SELECT avg(n) * 0.98 FROM d))
SELECT event_day, n FROM d, s WHERE stop_at IS NULL OR event_day <= stop_at
""")
def stop_flag(spark, sf_dir):
    days = _t(spark, sf_dir, "events").groupBy(_date("ts").alias("event_day")).agg(F.count("*").alias("n"))
    mean = days.agg((F.avg("n") * 0.98).alias("low"))
    rows = days.join(F.broadcast(mean))
    return R.until_stop(rows, "event_day", F.col("n") < F.col("low")).select("event_day", "n")


@_query("""
SELECT l.l_orderkey AS match_id, cast(o_orderdate AS date) AS match_date, cast(l_partkey AS varchar) AS team1, cast(l_suppkey AS varchar) AS team2, cast(l_quantity AS bigint) AS team1_score, cast(l_linenumber AS bigint) AS team2_score,
  CASE WHEN l_quantity > l_linenumber THEN cast(l_partkey AS varchar) ELSE cast(l_suppkey AS varchar) END AS winner
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE cast(o_orderdate AS date) BETWEEN date '1996-01-01' AND date '1998-06-30' AND l_partkey <> l_suppkey AND cast(l_quantity AS bigint) <> l_linenumber
""")
def validity_filter(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("match_id"), _date("o_orderdate").alias("match_date"))
    rows = _t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("match_id"), F.col("l_partkey").cast("string").alias("team1"), F.col("l_suppkey").cast("string").alias("team2"), F.col("l_quantity").cast("bigint").alias("team1_score"), F.col("l_linenumber").cast("bigint").alias("team2_score")
    ).join(o, "match_id")
    rows = rows.withColumn("winner", S.winner(F.col("team1"), F.col("team2"), F.col("team1_score"), F.col("team2_score")))
    start, end = F.lit("1996-01-01").cast("date"), F.lit("1998-06-30").cast("date")
    return R.valid_matches(rows, start, end).select("match_id", "match_date", "team1", "team2", "team1_score", "team2_score", "winner")


_PLAIN = r"trim(regexp_replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))"


@_query("SELECT page_id, " + _PLAIN.format(r"regexp_extract(html, '<title>([^<]*)</title>', 1)") + " AS title FROM pages")
def html_title(spark, sf_dir):
    return extract.plain_titles(_t(spark, sf_dir, "pages"))


@_query(r"""
WITH a AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '<script>.*?</script>', '', 'g'), '<a href="([^"]*)"', 1) AS h FROM pages)
SELECT page_id, cast(i - 1 AS bigint) AS ordinal, replace(x, '&amp;', '&') AS href FROM (SELECT page_id, unnest(h) AS x, generate_subscripts(h, 1) AS i FROM a)
""")
def html_anchors(spark, sf_dir):
    return extract.anchors(_t(spark, sf_dir, "pages")).select("page_id", "ordinal", "href")


@_query("SELECT c_mktsegment AS market_segment, c_custkey AS customer_key, c_name AS name FROM customer")
def rename_project_reorder(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").withColumnsRenamed({"c_custkey": " Customer Key", "c_name": "NAME ", "c_mktsegment": "Market Segment"})
    return R.reorder(R.clean_names(rows).drop("c_nationkey", "c_acctbal", "not_there"), ["market_segment", "missing"])


@_query("""
SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'good' END, d.lang) AS lang, d.source, l.toxic AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def selective_overwrite(spark, sf_dir):
    labels = _t(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("").alias("lang"), "toxic")
    return R.overwrite(_t(spark, sf_dir, "documents").select("doc_id", "lang", "source"), labels, ["doc_id"])


@_query("SELECT o_orderkey, cast(try_cast(CASE WHEN o_orderstatus = 'P' THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date) AS date) AS match_date FROM orders")
def lenient_date(spark, sf_dir):
    text = F.when(F.col("o_orderstatus") == "P", "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", S.lenient_timestamp(text).cast("date").alias("match_date"))


@_query("SELECT cast(ts AS date) AS event_day, min(ts) AS oldest, max(ts) AS newest FROM events GROUP BY 1")
def page_min_max(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy(_date("ts").alias("event_day")).agg(F.min("ts").alias("oldest"), F.max("ts").alias("newest"))
