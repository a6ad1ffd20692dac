"""From files to ratings, searches, tables and documents."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from laddersmith.operators import folds, intervals, joins, stats
from laddersmith.plans import evaluation, export, files, history
from laddersmith.plans.registry import BATCH, MODELS, make

PLAYERS = [f"Player {c}" for c in "ABCDEFGHIJKLMNOP"]
TEAMS = {f"T{i}": PLAYERS[4 * i : 4 * i + 4] + ([PLAYERS[0]] if i == 2 else []) for i in range(4)}


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    rng = random.Random(2)
    lines = ["Time,Team 1,Score 1,Team 2,Score 2,Outcome Only,Tournament,Players"]
    for i in range(60):
        a, b = rng.sample(range(5), 2)  # T4 has no roster
        s1, s2 = rng.randint(0, 9), rng.randint(0, 9)
        t = f"{1 + i // 28}/{1 + i % 28}/2024 {9 + i % 3}:00"
        lines.append(f"{t},T{a},{'x' if i == 7 else '' if i == 9 else s1},T{b},{'3.0' if i == 11 else s2},{'1' if i % 9 == 0 else ''},{'yes' if i % 10 == 0 else ''},{6 if i % 4 == 0 else ''}")
    lines.append("someday,T0,3,T1,2")
    (d / "games.csv").write_text("\n".join(lines) + "\n")
    width = max(map(len, TEAMS.values()))
    rows = [",".join(TEAMS)] + [",".join(TEAMS[t][i] if i < len(TEAMS[t]) else "" for t in TEAMS) for i in range(width)]
    (d / "teams.csv").write_text("\n".join(rows) + "\n")
    config = {"players_on_court_default": 6, "models": {"trueskill": {"defaults": {"mu": 50.0}, "search": {"draw_probability": {"type": "float", "low": 0.05, "high": 0.3}}, "trials": 2}, "bt_vet": {"defaults": {}, "search": {"sigma": {"type": "categorical", "choices": [2.0, 4.0]}}, "trials": 2}}}
    (d / "config.json").write_text(json.dumps(config))
    return d


def test_scores_that_cannot_be_read(spark, paths):
    games, _ = files.games_of(spark, str(paths / "games.csv"), str(paths / "teams.csv"))
    rows = {r.game_id: r for r in games.collect()}
    assert sum(r.s1 is None or r.s2 is None for r in rows.values()) == 3 and sum(r.ts is None for r in rows.values()) == 1
    assert {r.on_court for r in rows.values()} == {6, 8}


@pytest.mark.parametrize("model", list(MODELS))
def test_every_model_rates_named_players(spark, paths, model):
    h = files.ratings(spark, str(paths / "games.csv"), str(paths / "teams.csv"), model).cache()
    assert {r.player for r in h.select("player").distinct().collect()} == set(PLAYERS)
    first = h.agg(F.min("ts").alias("t")).head().t
    assert h.where(F.col("ts") == F.lit(first)).count() == len(PLAYERS)  # the seed row
    assert all(math.isfinite(r.rating) for r in h.collect())
    if model in BATCH:
        assert h.select("ts").distinct().count() > 30


def test_training_over_files(spark, paths):
    out = files.train(spark, str(paths / "games.csv"), str(paths / "teams.csv"), str(paths / "config.json"), out=str(paths / "best.json"), limit_eval_games=5)
    assert set(out) == {"chrono", "new_team"} and set(out["chrono"]) == {"trueskill", "bt_vet"}
    assert out["chrono"]["trueskill"]["params"]["mu"] == 50.0 and out["new_team"]["bt_vet"]["params"]["sigma"] in (2.0, 4.0)
    assert json.loads((paths / "best.json").read_text())["chrono"]["bt_vet"]["metrics"]["n"] > 20


def test_text_choices(spark):
    t = evaluation.sample_trials(spark, {"kind": {"type": "categorical", "choices": ["left"]}, "n": {"type": "int", "low": 2, "high": 2}}, 1)
    assert t.head().params == {"kind": '"left"', "n": "2"}


@pytest.mark.parametrize("model", ["elo", "bt_mov", "bt_uncert", "bt_normal", "ttt"])
def test_new_team_predictions_see_only_earlier_games(spark, paths, model):
    games, _ = files.games_of(spark, str(paths / "games.csv"), str(paths / "teams.csv"))
    games = games.cache()
    got = {(r.team, r.game_id): r.p for r in evaluation.new_team_predictions(games, model).collect()}
    order = folds.as_games(games.where("ts is not null").toPandas())
    first = {}
    for g in order:
        for t in g.teams:
            first.setdefault(t, g.day)
    for (team, gid), p in list(got.items())[::7]:
        m, fed = MODELS[model](), 0
        for at in sorted({d for d in first.values() if d <= first[team]}):
            while fed < len(order) and order[fed].day < at:
                m.update(order[fed])
                fed += 1
            if model == "ttt":
                m.converge()
        g = next(x for x in order if x.game_id == gid)
        want = m.predict(g)
        assert p == pytest.approx(want if g.teams[0] == team else 1 - want, abs=1e-5)


def test_resumed_batch_history_is_the_rest_of_the_whole(spark, paths):
    games, _ = files.games_of(spark, str(paths / "games.csv"), str(paths / "teams.csv"))
    games = games.where("ts is not null").cache()
    cut = games.selectExpr("percentile_approx(ts, 0.5) AS t").head().t
    whole = {(r.ts, r.player): r.rating for r in history.batch_history(games, "bt_vet").where(F.col("ts") > F.lit(cut)).collect()}
    state = history.batch_history(games.where(F.col("ts") <= F.lit(cut)), "bt_vet").withColumn("mu", F.col("theta")).withColumn("sigma", F.lit(None).cast("double"))
    rest = {(r.ts, r.player): r.rating for r in history.resume_history(games, history.snapshot(state), "bt_vet").collect()}
    assert whole and rest.keys() == whole.keys() and all(rest[k] == pytest.approx(v, abs=1e-4) for k, v in whole.items())


def test_uncertain_ratings_average_one_thousand():
    rng = random.Random(5)
    m = MODELS["bt_uncert"]()
    for i in range(40):
        a, b = rng.sample(list(TEAMS), 2)
        m.update(folds.Game(i, float(i), TEAMS[a], TEAMS[b], rng.randint(0, 9), rng.randint(0, 9), teams=(a, b)))
    m.converge()
    names, theta, shown = m.table()
    assert np.mean(shown) == pytest.approx(1000) and len(set(np.round(shown, 6))) > 3
    assert m.expose("nobody") == 1000.0 and m.expose(names[0]) == pytest.approx(shown[0])


def test_six_games_of_one_pair_as_head_to_head(spark):
    m = MODELS["bt_uncert"]()
    for i in range(6):
        m.update(folds.Game(i, float(i), [1], [2], 5, 2, teams=("a", "b")))
    m.converge()
    r = spark.createDataFrame([(p, float(t), float(m.sigmas[p]), True) for p, t in m.theta.items()], "player long, theta double, sigma double, active boolean")
    want = {x.player: x.rating for x in stats.head_to_head(r).collect()}
    assert {p: m.expose(p) for p in (1, 2)} == pytest.approx(want, abs=1e-6)


def test_dense_history_carries_ratings_forward(spark):
    h = spark.createDataFrame([(1, "a", 1.0), (3, "a", 2.0), (2, "b", 5.0)], "s long, player string, rating double").select(F.timestamp_seconds("s").alias("ts"), "player", "rating")
    got = {(r.s, r.player): r.rating for r in history.dense(h, spark.createDataFrame([("a",), ("b",), ("c",)], "player string"), 9.0).select(F.unix_timestamp("ts").alias("s"), "player", "rating").collect()}
    assert got == {(1, "a"): 1.0, (2, "a"): 1.0, (3, "a"): 2.0, (1, "b"): 9.0, (2, "b"): 5.0, (3, "b"): 5.0, (1, "c"): 9.0, (2, "c"): 9.0, (3, "c"): 9.0}


def test_statistics_document(spark, paths):
    lines = files.statistics(spark, str(paths / "games.csv"), str(paths / "teams.csv"), "elo")
    doc = export.document(lines)
    assert doc["metadata"]["num_players"] == 16 and doc["metadata"]["num_teams"] == 4
    assert len(doc["games"]) == 60 and len(doc["games_with_scores"]) == 57 == doc["metadata"]["num_games"]  # three scores are no integers
    assert sorted(doc["teams"]["T2"]["members"]) == sorted(TEAMS["T2"]) and doc["teams"]["T2"]["history"]
    a = doc["players"]["Player A"]
    assert sorted(a["teams"]) == ["T0", "T2"] and a["games"] == a["wins"] + a["losses"] + a["draws"] and a["history"]
    assert sum(g["tournament"] for g in doc["games"]) == 0  # "yes" is no 1


def test_statistics_document_against_brute_force(spark, paths):
    """Every player's and team's values at every timestamp, with the first row of 1000, and peaks, lows and records from them."""
    doc = export.document(files.statistics(spark, str(paths / "games.csv"), str(paths / "teams.csv"), "elo"))
    games, _ = files.games_of(spark, str(paths / "games.csv"), str(paths / "teams.csv"))
    m = make("elo", {})
    rows, last = [dict.fromkeys(PLAYERS, 1000.0)], object()
    for x in folds.as_games(games.toPandas()):
        m.update(x)
        now = {p: m.expose(p) for p in PLAYERS}
        rows = rows[:-1] if x.day == last else rows
        rows.append(now)
        last = x.day
    stamps = doc["metadata"]["timestamps"]
    assert len(stamps) == len(rows) and stamps[-1] is None and stamps[:-1] == sorted(stamps[:-1])
    for p in PLAYERS:
        own, got = [r[p] for r in rows], doc["players"][p]
        assert got["history"] == pytest.approx(own, abs=0.0051)
        assert (got["current"], got["peak"], got["lowest"]) == pytest.approx((own[-1], max(own), min(own)), abs=0.0051)
    for t, members in TEAMS.items():
        want = [sum(r[p] for p in members) / len(members) for r in rows]
        assert doc["teams"][t]["history"] == pytest.approx(want, abs=0.0051) and doc["teams"][t]["current"] == pytest.approx(want[-1], abs=0.0051)


@pytest.mark.parametrize(("width", "stretch"), [(1, 1), (2, 3), (256, 4096)])
def test_filled_histories_against_brute_force(spark, width, stretch):
    """Blocks and stretches of all sizes, rows at one time, NaN, rows without a time, entities without any."""
    rng = random.Random(width)
    rows = [(rng.randrange(12) if rng.random() < 0.95 else None, g, f"p{rng.randrange(5)}", rng.choice([1.5, 2.5, float("nan"), float(g)])) for g in range(60)]
    h = spark.createDataFrame(rows, "s long, game_id long, player string, rating double").select(F.timestamp_seconds("s").alias("ts"), "game_id", "player", "rating")
    members = spark.createDataFrame([(f"p{i}",) for i in range(7)] + [(None,)], "player string")
    got = {(r.s, r.player): r.rating for r in intervals.long(*intervals.filled(intervals.changes(h, "player"), "player", members, 9.0, width, stretch), "player").select(F.unix_timestamp("ts").alias("s"), "player", "rating").collect()}
    key = lambda s: (s is None, s or 0)
    want = {}
    for s in {r[0] for r in rows}:
        for p in (f"p{i}" for i in range(7)):
            past = sorted((key(r[0]), r[1], r[3]) for r in rows if r[2] == p and key(r[0]) <= key(s))
            v = past[-1][2] if past else 9.0
            want[s, p] = None if v != v else v
    assert got == want


def test_team_means_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(20), g, f"p{rng.randrange(6)}", rng.choice([float("nan"), rng.gauss(0, 9)])) for g in range(50)]
    h = spark.createDataFrame(rows, "s long, game_id long, player string, rating double").select(F.timestamp_seconds("s").alias("ts"), "game_id", "player", "rating")
    teams = {"a": ["p0", "p1", "p2"], "b": ["p2", "p3"], "c": ["none"], "d": ["p4", "p5", "p0"]}
    r = spark.createDataFrame([(t, p) for t, ps in teams.items() for p in ps], "team string, player string")
    got = {(x.s, x.team): x.rating for x in intervals.long(*history.team_histories(h, r, 7.0), "team").select(F.unix_timestamp("ts").alias("s"), "team", "rating").collect()}
    for s in {x[0] for x in rows}:
        for t, ps in teams.items():
            touched = any(x[2] in ps and x[0] <= s for x in rows)
            now = [sorted((x[0], x[1], x[3]) for x in rows if x[2] == p and x[0] <= s)[-1:] for p in ps]
            now = [x[0][2] for x in now if x and x[0][2] == x[0][2]]
            want = sum(now) / len(now) if now else None if touched else 7.0
            assert got[s, t] == (pytest.approx(want, abs=1e-9) if want is not None else None), (s, t)


def test_sample_size_table(spark, paths):
    rows = files.sample_size_table(spark, str(paths / "games.csv"), str(paths / "teams.csv")).collect()
    assert [r.n for r in rows] == sorted((r.n for r in rows), reverse=True) and len(rows) == 16


def test_effective_sample_sizes_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    series = {k: [rng.gauss(0, 1) + (3 if i % 7 < 3 else 0) for i in range(n)] for k, n in enumerate([1, 2, 5, 49, 50, 51, 52, 300, 1100])}
    rows = [(k, i, x) for k, xs in series.items() for i, x in enumerate(xs)] + [(99, i, 4.0) for i in range(60)]
    rng.shuffle(rows)
    got = {r.k: r for r in stats.effective_sample_size(spark.createDataFrame(rows, "k int, t int, v double"), "k", ["t"], "v").collect()}
    for k, xs in series.items():
        n, d = len(xs), np.array(xs) - np.mean(xs)
        out = 0.0
        for lag in range(1, min(50, n - 1) + 1):
            r = (d[:-lag] @ d[lag:]) / (n - lag) / (d @ d / n)
            if r <= 0:
                break
            out += r
        assert got[k].n == n and got[k].ess == pytest.approx(n / (1 + 2 * out) if n > 1 else 1.0, rel=1e-9)
    assert math.isnan(got[99].ess)


BLOCK = '<div class="schedule-match" data-iso-datetime="{t}"><div class="home-team"><span class="team-display">{a}</span></div><span class="static-scores">{s}</span><div class="away-team"><span class="team-display">{b}</span></div></div>'


def test_schedule_pages_join_the_games_file(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "fall.html").write_text("".join(BLOCK.format(t=t, a=a, b=b, s="3 - 1") for t, a, b in (("2024-01-02T10:00:00", "Y", "X"), ("2024-01-02T11:30:00", "X", "Y"), ("2024-01-02T11:30:00", "Y", "X"))))
    (tmp_path / "g.csv").write_text("Time,Team 1,Score 1,Team 2,Score 2\n1/2/2024 10:00,X (F23),1,Y (F23),3\n")
    (tmp_path / "s.csv").write_text("file_type,filename,season,suffix\ngame,fall.html,Fall,(F23)\n")
    got = [tuple(r) for r in files.schedule_additions(spark, str(tmp_path / "pages"), str(tmp_path / "g.csv"), str(tmp_path / "s.csv")).collect()]
    assert got == [("1/2/2024 10:00", "X (F23)", "1", "Y (F23)", "3"), ("1/2/2024 11:30:00", "X (F23)", "3", "Y (F23)", "1")]


def test_roster_pages_replace_their_teams(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "red.html").write_text('<h1>Red</h1><div class="roster-row"><span>Ann</span></div><div class="roster-row"><span>Search player</span></div><div class="roster-row"><span>bo b.</span></div>')
    (tmp_path / "r.csv").write_text("Red,Blue,Red (S22)\nOld,Cy,Di\n")
    (tmp_path / "s.csv").write_text("file_type,filename,season,suffix\nteam,red.html,Fall,(F23)\n")
    (tmp_path / "a.csv").write_text("bo b,Bo Bell\n")
    got = {(r.team, r.player) for r in files.roster_additions(spark, str(tmp_path / "pages"), str(tmp_path / "r.csv"), str(tmp_path / "a.csv"), str(tmp_path / "s.csv")).collect()}
    assert got == {("Blue", "Cy"), ("Red (S22)", "Di"), ("Red (F23)", "Ann"), ("Red (F23)", "Bo Bell")}
    old, new = spark.createDataFrame([("Red", "x")], "team string, player string"), spark.createDataFrame([("Red (F23)", "y")], "team string, player string")
    assert joins.upsert_teams(old, new).count() == 2  # a team that isn't managed stays


def test_canonical_rosters(spark, tmp_path):
    (tmp_path / "r.csv").write_text("A,B\nJohn Smith,John Smyth\nJohn Smith,Zed\n")
    r, changed = files.canonical_rosters(spark, str(tmp_path / "r.csv"))
    assert {(x.team, x.player) for x in r.collect()} == {("A", "John Smith"), ("B", "John Smith"), ("B", "Zed")}
    assert [tuple(x) for x in changed.collect()] == [("John Smyth", "John Smith")]
