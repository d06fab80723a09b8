from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry import page_queries, queries, schemas
from quarry.config import JobConfig
from quarry.operators import extract
from quarry.plans import build, enrich, load
from quarry.sources import readers, writers
from quarry.streaming import upsert

RESULTS = """<div class="results-all">old</div><div class="results-all">
<div class="results-sublist"><span class="standard-headline">Results for February 14th 2026</span>
{entries}</div></div>"""
ENTRY = """<div class="result-con" {epoch}><a class="a-reset" href="/matches/{id}/x"><div class="team1"><div class="team">{a}</div></div><div class="team2"><div class="team">{b}</div></div>
<span class="event-name">Cup</span><div class="result-score">{spans}</div></a></div>"""


def entry(id, a="A", b="B", s=(2, 1), epoch=""):
    return ENTRY.format(id=id, a=a, b=b, spans=" - ".join(f"<span>{x}</span>" for x in s), epoch=f'data-zonedgrouping-entry-unix="{epoch}"' if epoch else "")


def test_load(spark):
    pages = [
        (0, RESULTS.format(entries=entry(1, s=("1<b>2</b>", 1)) + entry(2, a="TBD") + entry(3, s=(1,)) + entry(4, s=(1, 1)) + entry(5, a="X", b="X"))),
        (1, RESULTS.format(entries=entry(2, a="C") + entry(1, a="late") + entry(6, epoch="1770076800000") + entry(7, epoch="bad"))),
        (2, RESULTS.format(entries=entry(8, epoch="1600000000000"))),
        (3, RESULTS.format(entries=entry(9))),
        (4, "<p>no container</p>"),
    ]
    config = JobConfig(start_date=date(2026, 1, 1), end_date=date(2026, 12, 31))
    df = spark.createDataFrame(pages, "page_idx int, html string")
    loaded = load.load(df, config)
    out = loaded["matches_raw"]
    assert out.columns == schemas.MATCHES_RAW.names
    got = {r.match_id: r for r in out.collect()}
    assert set(got) == {"1", "2", "6", "7"}
    assert got["1"].team1 == "A" and got["1"].winner == "A" and got["6"].match_date == date(2026, 2, 3) and got["7"].match_date == date(2026, 2, 14)
    assert got["2"].source_url.endswith("/matches/2/x") and (got["1"].team1_score, got["1"].team2_score) == (12, 1)
    assert [r.page_idx for r in loaded["pages"].orderBy("page_idx").collect()] == [0, 1, 2] and loaded["errors"].count() == 0
    p = load.progress(loaded["pages"], config, 6.0).first()
    assert tuple(p) == (3, 364, 364, 100.0, 0.5, 0.0)
    p = load.progress(loaded["pages"].filter("page_idx < 2"), config, 6.0).first()
    days = (date(2026, 12, 31) - date(2026, 2, 3)).days
    assert p.covered_days == days and p.percent == pytest.approx(100 * days / 364) and p.eta_min == pytest.approx(6 / (days / 364) - 6)
    assert tuple(load.progress(loaded["pages"].limit(0), config, 0.0).first()) == (0, None, 364, None, 0.0, None)
    with pytest.raises(ValueError):
        JobConfig(start_date=date(2020, 1, 1)).checked()


def test_load_stops(spark):
    """At a page without dated results or without results at all, which is told; and not silently without any match."""
    config = JobConfig(start_date=date(2026, 1, 1), end_date=date(2026, 12, 31))
    undated = RESULTS.format(entries=entry(2)).replace("Results for February 14th 2026", "")
    frame = lambda *html: spark.createDataFrame(list(enumerate(html)), "page_idx int, html string")
    one, three = RESULTS.format(entries=entry(1)), RESULTS.format(entries=entry(3))
    assert [r.match_id for r in load.load(frame(one, undated, three), config)["matches_raw"].collect()] == ["1"]
    got = load.load(frame(one, "<p>no container</p>", three, None), config)
    assert [r.match_id for r in got["matches_raw"].collect()] == ["1"]
    assert [tuple(r) for r in got["errors"].collect()] == [("results", "1", "ValueError: no results container")]
    with pytest.raises(ValueError, match="no valid match"):
        load.load(frame(undated), config)


def test_clean(spark):
    df = spark.createDataFrame([("2024-01-02", 1), ("2024-01-02", 1), ("2024-01-02 00:00:00", 1), ("bad", 2)], ["Match Date", "N "])
    out = load.clean(df)
    assert out.columns == ["match_date", "n"] and out.count() == 3 and out.filter("match_date is null").count() == 1
    head, n, width = load.preview(out)
    assert (head.count(), n, width) == (3, 3, 2)


MATCH = """<div class="date" data-unix="1"></div><div class="event"><a href="/events/1/wrong">Wrong</a></div><div class="lineup standard-box"><div class="teamRanking"><a>#99</a></div></div>
<div class="team1-gradient"><a href="/team/10/a"><div class="teamName">Alpha</div></a></div><div class="team2-gradient"><a href="/team/20/b"><div class="teamName"></div></a></div>
<div class="timeAndEvent"><div class="date" data-unix="1770076800000"></div><div class="event"><a href="/events/77/e">Big Cup</a></div></div>
<div class="padding preformatted-text">Best of 3 (LAN)

* Final
** Beta forfeit<div>* Second stage</div><div>* Third   stage</div></div>
<div class="lineups"><div class="lineup standard-box"><a href="/team/999/no">No</a><div class="teamRanking"><a>World rank: #5</a></div><div class="box-headline"><a href="/team/10/a">Alpha</a></div>
<table><tr><td data-player-id="9"><img class="flag" title="DE"><div class="text-ellipsis">nine</div></td><td data-player-id="10"><div class="text-ellipsis">ten</div></td><td data-player-id="10"></td><td data-player-id="-"></td></tr></table></div>
<div class="lineup standard-box"><div class="box-headline"><a href="/team/20/b">Beta</a></div></div></div>
<div class="veto-box"><div class="padding">x</div></div><div class="veto-box"><div class="padding"><div>1. Alpha removed Dust</div><div>2. Beta picked Mirage</div><div>3. Alpha picked mirage</div><div>4. Nuke was left over</div><div>note</div></div></div>
<div class="mapholder"><div class="mapname">Mirage</div><div class="results played"><div class="results-left"><div class="results-team-score">1<i>3</i></div></div><div class="results-right"><div class="results-team-score">10</div></div>
<div class="results-center-half-score"><span> (</span><span class="ct">8</span><span class="t">7</span>;<span class="t">5</span><span class="ct">3</span></div><a class="results-stats" href="/stats/matches/mapstatsid/555/x">S</a></div></div>
<div class="mapholder"><div class="mapname">Nuke</div><div class="optional results"></div><a class="results-stats" href="/stats/matches/mapstatsid/556/x">S</a></div><div class="mapholder"><div class="mapname">Default</div></div>"""
STATS = """<div class="match-info-box"><a>head</a> Mirage <div class="team-left"><a href="/stats/teams/10/a">Alpha</a><div class="bold">1<b>3</b></div></div><div class="team-right"><a href="/stats/teams/20/b">Beta</a><div class="bold">10</div></div></div>
<div class="match-info-row"><div class="right"><span class="bold">13</span><span class="ct-color">8</span><span class="t-color">7</span><span class="t-color">5</span><span class="ct-color">3</span></div></div>
<table class="stats-table totalstats"><thead><tr><td class="st-player"><a href="/stats/players/1/head">head</a></td></tr></thead><tbody><tr><td><a href="/stats/players/2/other">not the player's cell</a></td></tr>
<tr><td class="st-player"><img><a href="/stats/players/9/nine">nine</a></td><td class="st-kills">20<span>(9)</span></td><td class="st-opkd">3 : <b>2</b></td><td class="st-assists">4<span> (1)</span></td><td class="st-deaths">11 <span>(2)</span></td>
<td class="st-adr">88<span>.5</span></td><td class="st-kast">71.4%</td><td class="st-rating">1.20</td><td class="st-mks">3</td><td class="st-clutches">1</td><td class="st-roundSwing">+1.5%</td></tr></tbody></table>
<table class="stats-table totalstats"><tbody><tr><td class="st-player"><a href="/stats/players/30/z">z</a></td><td class="st-kills">-</td></tr></tbody></table>"""


def rows_of(df, *order):
    return [r.asDict() for r in df.orderBy(*order).collect()]


def test_enrich(spark):
    """Every column of the five relations, and the errors."""
    raw = [("1", date(2026, 2, 3), "Cup", "A", "Beta", "A", "u"), ("2", date(2026, 2, 4), "Cup", "C", "D", "C", "u2"), ("3", date(2026, 2, 5), "Cup", "C", "D", "C", "u3"), ("4", date(2026, 2, 6), "Cup", "C", "D", "C", "u4")]
    raw = spark.createDataFrame(raw, "match_id string, match_date date, event_name string, team1 string, team2 string, winner string, source_url string")
    pages = spark.createDataFrame([("1", MATCH), ("2", ""), ("3", None), ("9", MATCH)], "match_id string, html string")
    stats = spark.createDataFrame([("555", STATS), ("556", None), ("999", STATS)], "mapstatsid string, html string")
    out = enrich.enrich(raw, pages, stats, JobConfig())
    one, two = rows_of(out["matches_enriched"], "match_id")
    assert one == {
        "match_id": "1", "match_date": date(2026, 2, 3), "match_datetime_utc": "2026-02-03T00:00:00+00:00", "event_id": "77", "event_name": "Big Cup", "team1": "Alpha", "team2": "Beta", "team1_id": "10", "team2_id": "20", "team1_rank": 5, "team2_rank": None, "bo": 3,
        "lan_online": "LAN", "match_context": "Final | Second stage | Third stage", "forfeit_note": "Beta forfeit", "winner_raw": "A", "source_url": "u", "team1_roster_hash": "9-10-10", "team2_roster_hash": "",
    }
    assert (two["match_id"], two["team1"], two["bo"], two["match_context"], two["match_datetime_utc"], two["team1_roster_hash"]) == ("2", "C", None, "", "", "")
    player = lambda i, name, country: {"match_id": "1", "team_ordinal": 1, "team_id": "10", "team_name": "Alpha", "player_id": i, "player_name": name, "country": country}
    assert rows_of(out["match_lineups"], "player_id", "player_name") == [player(None, "", ""), player("10", "", ""), player("10", "ten", ""), player("9", "nine", "DE")]
    veto = sorted((r.step_number or 99, r.action, r.map_name, r.team_name) for r in out["veto_steps"].collect())
    assert veto == [(1, "removed", "Dust", "Alpha"), (2, "picked", "Mirage", "Beta"), (3, "picked", "mirage", "Alpha"), (4, "left_over", "Nuke", ""), (99, "", "", "")]
    maps = rows_of(out["match_maps"], "map_no")
    assert maps[0] == {
        "match_id": "1", "map_no": 1, "map_name": "Mirage", "played": True, "optional": False, "is_default_forfeit_map": False, "team1_map_score": 13, "team2_map_score": 10, "mapstatsid": "555", "stats_href": "/stats/matches/mapstatsid/555/x", "picked_by": "Alpha", "is_decider": False,
        "team1_ct_rounds": 8, "team1_t_rounds": 5, "team2_ct_rounds": 3, "team2_t_rounds": 7, "team1_starting_side": "CT", "map_name_from_stats": "Mirage", "team_left_id": "10", "team_left_name": "Alpha", "team_right_id": "20", "team_right_name": "Beta",
        "team_left_score_stats": 13, "team_right_score_stats": 10, "team_left_ct_rounds": 8, "team_left_t_rounds": 5, "team_right_ct_rounds": 3, "team_right_t_rounds": 7, "team_left_starting_side": "CT",
    }
    assert maps[1]["is_decider"] and maps[1]["optional"] and not maps[1]["played"] and maps[1]["map_name_from_stats"] is None and maps[1]["team1_starting_side"] == "" and maps[2]["is_default_forfeit_map"]
    nine, z = rows_of(out["map_player_stats"], "player_name")
    assert nine == {
        "match_id": "1", "map_no": 1, "mapstatsid": "555", "team_id": "10", "player_id": "9", "player_name": "nine", "kills": 20, "hs_kills": 9, "assists": 4, "flash_assists": 1, "deaths": 11, "traded_deaths": 2, "adr": 88.5, "kast": 71.4,
        "opening_kills": 3, "opening_deaths": 2, "rating": 1.2, "multi_kills": 3, "clutch_wins": 1, "round_swing": 1.5,
    }
    assert (z["team_id"], z["player_id"], z["kills"], z["hs_kills"], z["adr"]) == ("20", "30", None, None, None)
    assert sorted((r.kind, r.key, r.error) for r in out["errors"].collect()) == [("map statistics", "556", "ValueError: no page"), ("match", "3", "ValueError: no page"), ("match", "4", "no saved page")]


def test_pages_are_parsed_once(spark):
    """One Python pass a kind of page: the relations read what it has written."""
    raw = spark.createDataFrame([("1", date(2026, 2, 3), "Cup", "A", "Beta", "A", "u")], "match_id string, match_date date, event_name string, team1 string, team2 string, winner string, source_url string")
    pages, stats = spark.createDataFrame([("1", MATCH)], "match_id string, html string"), spark.createDataFrame([("555", STATS)], "mapstatsid string, html string")
    out = enrich.enrich(raw, pages, stats, JobConfig())
    assert not any("MapInArrow" in df._jdf.queryExecution().toString() for df in out.values())


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.mark.parametrize("compat", [False, True])
def test_build(spark, tmp_path, compat):
    raw = "match_id,match_date,event_id,event_name,team1,team2,team1_score,team2_score,winner,source_url\n"
    raw += "1,2024-01-05,,Cup,A  x,B,2,1,A x,u\n1,2024-01-03,,Early,A,B,2,0,A,u\n2,2020-01-01,,Old,A,B,2,1,A,u\n3,2024-02-01,,Cup,C,D,1,2,D,u3\nbad,never,,Cup,C,D,1,2,D,u3\n"
    write(tmp_path / "raw.csv", raw)
    head = "match_id,match_date,match_datetime_utc,event_id,event_name,team1,team2,team1_id\n"
    write(tmp_path / "one/matches_enriched.csv", head + "1,2024-01-03,2024-01-03T10:00:00+00:00,77,Enriched,,B,10.0\n9,2024-01-03,,,x,,,\n")
    write(tmp_path / "two/matches_enriched.csv", head + "1,2024-01-03,,78,NoDate,,B,11\n")
    write(tmp_path / "one/match_maps.csv", "match_id,map_no,map_name,played\n1,1,Dust,True\n1,1,Mirage,False\n9,1,Nuke,True\n")
    write(tmp_path / "two/match_maps.csv", "match_id,map_no,map_name,played\n1,2,Nuke,True\n")
    write(tmp_path / "two/match_lineups.csv", "\n")
    config = JobConfig(raw_path=str(tmp_path / "raw.csv"), enriched_dirs=(str(tmp_path / "one"), str(tmp_path / "two"), str(tmp_path / "none")), output_dir=str(tmp_path / "out"), compat=compat)
    text = build.run(spark, config)
    assert "matches_final: 2 rows" in text and "match_maps: 2 rows" in text and "match_lineups: 0 rows" in text
    final = spark.read.option("header", True).csv(str(tmp_path / "out/matches_final.csv"))
    got = {r.match_id: r for r in final.collect()}
    assert set(got) == {"1", "3"} and final.columns[:2] == ["match_id", "match_date"]
    assert got["1"].event_name == ("NoDate" if compat else "Enriched") and got["1"].team1_id == ("11" if compat else "10")
    assert got["3"].event_name == (None if compat else "Cup")
    assert ("event_id" in final.columns) != compat and {"event_id_raw", "event_id_enriched"} <= set(final.columns)
    maps = {r.map_no: r for r in spark.read.option("header", True).csv(str(tmp_path / "out/match_maps.csv")).collect()}
    assert maps["1"].map_name == "Mirage" and maps["2"].match_date == "2024-01-03"


@pytest.mark.parametrize("compat", [False, True])
@pytest.mark.parametrize("name, rows", [("none", ""), ("one", ""), ("one", "9,2024-01-03,x\n")])
def test_build_without_enrichment(spark, tmp_path, compat, name, rows):
    """No enriched folder, none with rows, or none of these matches: the raw rows are the final ones."""
    write(tmp_path / "raw.csv", "match_id,match_date,event_name,team1,team2,team1_score,team2_score,winner,source_url\n2,2024-02-05,Cup,A,B,2,1,A,u2\n1,2024-01-05,Cup,A,B,2,1,A,u\n")
    write(tmp_path / "one/matches_enriched.csv", "match_id,match_date,team1\n" + rows)
    build.run(spark, JobConfig(raw_path=str(tmp_path / "raw.csv"), enriched_dirs=(str(tmp_path / name),), output_dir=str(tmp_path / "out"), compat=compat))
    final = spark.read.option("header", True).csv(str(tmp_path / "out/matches_final.csv"))
    got = sorted(final.collect(), key=lambda r: r.match_id)
    assert [(r.match_id, r.match_date, r.event_name, r.team1, r.team2, r.source_url) for r in got] == [("1", "2024-01-05", "Cup", "A", "B", "u"), ("2", "2024-02-05", "Cup", "A", "B", "u2")]


def test_arrival(spark, tmp_path):
    """Places follow files and lines, however many tasks read them."""
    for k in range(3):
        write(tmp_path / f"x/{k}.csv", "a,b\n" + "".join(f"{k},{j}\n" for j in range(4000)))
    write(tmp_path / "wide.csv", 'a,b\n"one\ntwo",1\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = readers.arrived(readers.read_csv(spark, str(tmp_path / "x"), compat=True))
        assert df.rdd.getNumPartitions() > 6
        assert [(int(r.a), int(r.b)) for r in df.orderBy("__row").collect()] == [(k, j) for k in range(3) for j in range(4000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert readers.read_csv(spark, str(tmp_path / "wide.csv"), multiline=True).first().a == "one\ntwo"


def test_sources(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_csv(spark, str(tmp_path / "no.csv"))
    assert readers.read_csv(spark, str(tmp_path / "no.csv"), required=False) is None
    write(tmp_path / "x.csv", "a,b\nNA,\n")
    assert readers.read_csv(spark, str(tmp_path / "x.csv")).first() == ("NA", None)
    assert readers.read_csv(spark, str(tmp_path / "x.csv"), compat=True).first() == (None, None)
    write(tmp_path / "pages/match-12.html", "<p>ok</p>\n<p>two</p>")
    write(tmp_path / "pages/match-13.html", "<title>Just a moment...</title>")
    pages, refused = readers.read_pages(spark, str(tmp_path / "pages"), r"match-([0-9]+)\.html")
    assert [(r.page_key, "two" in r.html) for r in pages.collect()] == [("12", True)] and refused.count() == 1
    writers.write_csv(spark.range(3), str(tmp_path / "out"), single=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3


def test_challenge_pages(spark, tmp_path):
    """The marks count wherever they stand; words of titles do not make a real page a challenge."""
    write(tmp_path / "p/match-1.html", "x" * 30000 + "<h2 id='challenge-error-title'>")
    write(tmp_path / "p/match-2.html", "y" * 30000 + "Enable JavaScript and cookies to continue")
    write(tmp_path / "p/match-3.html", "<title>A match</title> Just a moment, attention required")
    write(tmp_path / "p/match-4.html", "<title>Attention Required! | Cloudflare</title>")
    pages, refused = readers.read_pages(spark, str(tmp_path / "p"), r"match-([0-9]+)\.html")
    assert [r.page_key for r in pages.collect()] == ["3"] and sorted(r.page_key for r in refused.collect()) == ["1", "2", "4"]


def test_streaming_upsert(spark, tmp_path):
    state = {}
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, o int, v string").write.parquet(str(tmp_path / "in/one"))

    def target(df, epoch):
        state["now"] = spark.createDataFrame(upsert.upsert(state.get("now"), df, ["k"], ["o"]).collect(), df.schema)

    schema = spark.createDataFrame([], "k int, o int, v string").schema
    for _ in range(2):
        q = upsert.start(spark, str(tmp_path / "in/*"), schema, target, str(tmp_path / "cp"))
        q.awaitTermination()
        spark.createDataFrame([(1, 2, "c"), (2, 0, "old")], "k int, o int, v string").write.mode("ignore").parquet(str(tmp_path / "in/two"))
    assert sorted((r.k, r.v) for r in state["now"].filter(F.col("o") > 0).collect()) == [(1, "c"), (2, "b")]


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_maps_by_the_vetoes_of_their_page(spark):
    """As by a join with all veto steps, and no row moves."""
    pages = spark.createDataFrame([("1", MATCH), ("2", MATCH.replace("picked mirage", "picked Nuke")), ("3", ""), ("4", None)], "match_id string, html string")
    read = extract.match_pages(pages, relations=["vetoes", "maps"])
    assert read.columns == ["match_id", "vetoes", "maps", "error"]
    got = extract.match_maps(read)
    assert rows_of(got, "match_id", "map_no") == rows_of(extract.match_maps(read, extract.veto_steps(read)), "match_id", "map_no")
    assert got.count() == 6 and shuffles(got) == 0


@pytest.mark.parametrize("name, most", [("match_page_maps", 1), ("stats_page_players", 1), ("match_page_lineups", 2), ("match_page_meta", 3)])
def test_pages_are_not_shuffled(spark, name, most):
    """What pages are written from moves, and what is read from them."""
    got = page_queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert shuffles(got) <= most


def test_titles_equal_the_sql_and_those_of_a_browser(spark, tmp_path):
    """References without a semicolon, quotes, markup and odd spaces in titles: the query as its SQL, titles() as HTML has it."""
    titles = ["a &amp", "&quot;b&quot; &lt;c&gt; &#x27;d&#x27;", "&amp;lt; &amp;amp;lt;", " e\t\n\x0b f\xa0\u2003g ", "h<b>i</b></title><title>j", "&nbsp;k&eacute;&", ""]
    pages = [f"<html><title>{t}</title><h1>x</h1>" for t in titles] + ["<TITLE>l</TITLE>", "<title lang=en>m</title>", "<p>", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    want = duckdb.sql(queries.SQL["html_title"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert sorted(tuple(r) for r in queries.QUERIES["html_title"](spark, str(tmp_path)).select("page_id", "title").collect()) == sorted(want)
    read = {r.page_id: r.title for r in extract.titles(spark.read.parquet(str(tmp_path / "pages.parquet"))).collect()}
    assert read[0] == "a &" and read[1] == '"b" <c> \'d\'' and read[7] == "l" and read[8] == "m"
