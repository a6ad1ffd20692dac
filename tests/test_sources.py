import json

from pyspark.sql import functions as F

from laddersmith.functions.names import lookup_key
from laddersmith.operators import joins, stats
from laddersmith.sources import csv_files, html_files, sinks


def test_games_csv(spark, tmp_path):
    p = tmp_path / "games.csv"
    p.write_text('Time,Team 1,Score 1,Team 2,Score 2,Outcome Only,Tournament\n1/2/2024 10:00,"A, x",3,B,1,,1\nsoon,C,x,D,2\nshort,row\n1/3/24,E,2,F,2,yes,,6\n')
    g = {r.team1: r for r in csv_files.read_games(spark, str(p)).collect()}
    assert sorted(g) == ["A, x", "C", "E"]
    assert (g["A, x"].s1, g["A, x"].tournament, g["A, x"].outcome_only) == (3, True, False)
    assert g["C"].ts is None and g["C"].s1 is None and g["C"].s2 == 2
    assert g["E"].outcome_only and g["E"].players_on_court == 6 and g["E"].ts.year == 2024


def test_rosters_and_aliases(spark, tmp_path):
    (tmp_path / "r.csv").write_text("T1,T2\nAnn Lee,Bo\n, Cy \nAnn-Lee,\n")
    (tmp_path / "a.csv").write_text("ann lee,Ann L.\nann-lee,Ann L.\nsolo\n")
    r = csv_files.read_wide_rosters(spark, str(tmp_path / "r.csv"), strip=True)
    assert {(x.team, x.player) for x in r.collect()} == {("T1", "Ann Lee"), ("T1", "Ann-Lee"), ("T2", "Bo"), ("T2", "Cy")}
    al = csv_files.read_aliases(spark, str(tmp_path / "a.csv"))
    out = joins.apply_aliases(r, al, lookup_key)
    assert sorted((x.team, x.player) for x in out.collect()) == [("T1", "Ann L."), ("T2", "Bo"), ("T2", "Cy")]
    assert {(x.alias, x.preferred) for x in al.collect()} == {("ann lee", "Ann L."), ("solo", "solo")}


def test_history_round_trip(spark, tmp_path):
    h = spark.createDataFrame([("2024-01-02 10:00:00", "a", 1.5), ("2024-01-02 10:00:00", "b", 2.5), ("2024-01-03 10:00:00", "a", 3.5)], "t string, player string, rating double").select(F.col("t").cast("timestamp").alias("ts"), "player", "rating")
    sinks.write_wide(sinks.wide_history(h), str(tmp_path / "h"))
    back = csv_files.read_history(spark, str(tmp_path / "h" / "block=0")).where("rating is not null")
    last = h.where("player = 'b'").withColumn("ts", F.expr("ts + INTERVAL 1 DAY"))  # what stands still is filled
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, h.unionByName(last).collect()))


def test_swap_in(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.swap_in(spark.range(3).toDF("x"), path)
    sinks.swap_in(spark.range(5).toDF("x"), path)
    assert spark.read.parquet(path).count() == 5 and spark.read.parquet(path + ".backup").count() == 3


def test_schedules(spark, tmp_path):
    d = tmp_path / "sub"
    d.mkdir()
    block = '<div class="row schedule-match" data-iso-datetime="2024-01-02T10:00:00"><div class="home-team"><span class="team-display">Home</span></div><span class="static-scores">3 : 2</span><div class="away-team"><span class="team-display">Away &amp; Co</span></div></div>'
    (d / "a.HTML").write_text(f"<html><body>{block}<div class='schedule-match' data-iso-datetime='2024-01-02'><div class='home-team'>x</div></div></body></html>")
    (d / "b.txt").write_text(block)
    rows = html_files.read_schedules(html_files.html_files(spark, str(tmp_path))).collect()
    assert [tuple(r) for r in rows] == [("a.HTML", "2024-01-02T10:00:00", "Home", "3", "Away & Co", "2")]
    epoch = block.replace('data-iso-datetime="2024-01-02T10:00:00"', 'data-datetime="1704189600"').replace("home-team", "left-team").replace("away-team", "right-team").replace(">Home<", ">Home 3-2 | x<")
    assert html_files.schedule_rows(epoch) == [("2024-01-02T10:00:00", "Home", "3", "Away & Co", "2")]
    assert html_files.schedule_rows(block.replace("3 : 2", "V") + block.replace("2024-01-02T10:00:00", "soon")) == []


def test_rosters_in_pages(spark):
    pages = [
        '<h1>Team A</h1><div class="roster-row"><span> Ann </span></div><div class="roster-row"><img title="Bo"></div><div class="roster-row"><span>Ann</span></div>',
        '<title>Team B - x | League and Tournament Scheduler by y</title><img title="Cy"><img title="Di">',
        '<ul class="team-list"><li class="team"><div class="team-members-container"><li class="list-group-item"><div class="col-md-4 x">Ed <b>Lee</b></div><div class="col-md-4">no</div></li></div></li></ul>',
        '<h1>Team D</h1><div class="guest-list-circle ttooltip img-circle" title="Flo"><img title="logo"></div><div class="guest-list-circle"></div>',
    ]
    df = spark.createDataFrame([(f"p{i}.html", p) for i, p in enumerate(pages)], "filename string, html string")
    got = sorted((r.team, r.slot, r.player) for r in html_files.read_rosters(df).collect())
    assert got == [("Team A", 0, "Ann"), ("Team A", 1, "Bo"), ("Team B - x", 0, "Cy"), ("Team B - x", 1, "Di"), ("Team D", 0, "Flo"), ("p2", 0, "Ed Lee")]
    cell = lambda *ps: '<div class="team-members-container">' + "".join(f'<li class="list-group-item"><div class="col-md-4">{p}</div></li>' for p in ps) + "</div>"
    page = f'<ul class="team-list"><li class="team"><div class="reg-team-name">X</div>{cell("Al", "WTNB", "Search player or create", "X", "Al", "Bo")}</li><li class="team"><h4>Open Draft Spring25</h4>{cell("No")}</li><li class="team"><h4 class="list-group-item-heading">Y</h4>{cell("Cy")}</li><li class="team">{cell("Di")}</li></ul>'
    assert html_files.registration_teams(page, "File (F23).html") == [("X", ["Al", "Bo"]), ("Y", ["Cy"]), ("File", ["Di"])]


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"models": {}}))
    assert csv_files.load_config(str(tmp_path / "c.json")) == {"models": {}}
    assert csv_files.load_config(str(tmp_path / "none.json"), strict=False) is None


def test_small_tables(spark):
    r = spark.createDataFrame([(1, 0.5, 0.1, True), (2, 0.0, 0.1, False)], "player long, theta double, sigma double, active boolean")
    assert {x.player: x.rating for x in stats.head_to_head(r).collect()} == {1: 2000.0, 2: 1000.0}
    s = spark.createDataFrame([(1, i, 2.0) for i in range(5)] + [(2, 0, 1.0)], "k long, t long, v double")
    got = {x.k: x.ess for x in stats.effective_sample_size(s, "k", ["t"], "v").collect()}
    assert got[1] != got[1] and got[2] == 1.0
