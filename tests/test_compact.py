"""What is shuffled of a game doesn't grow with rosters, trials or questions that are the same."""

import random

import pytest
from pyspark.sql import functions as F

from laddersmith import catalog
from laddersmith.operators import folds
from laddersmith.plans import evaluation

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def games(spark):
    rng = random.Random(5)
    rows = [(i, i // 3, *rng.sample(["a", "b", "c", "d"], 2), rng.randint(0, 3), rng.randint(0, 3)) for i in range(90)]
    df = spark.createDataFrame(rows, "game_id long, s long, team1 string, team2 string, s1 int, s2 int").withColumn("ts", F.timestamp_seconds(F.col("s") * 86400))
    roster = lambda c: F.expr(f"transform(sequence(1, 40), i -> cast(ascii({c}) * 100 + i as long))")
    df = df.withColumn("r1", roster("team1")).withColumn("r2", F.when(F.col("team2") == "d", F.array().cast("array<long>")).otherwise(roster("team2")))
    return df.withColumn("day", F.unix_timestamp("ts") / 86400.0).withColumn("outcome_only", F.lit(False)).withColumn("tournament", F.col("game_id") % 5 == 0).withColumn("on_court", F.lit(8)).withColumn("score1", F.col("s1")).withColumn("score2", F.col("s2")).drop("s").cache()


def test_games_name_their_sides_by_keys(games):
    flat, sides = folds.compact(games)
    assert not [c for c, kind in flat.dtypes if kind.startswith(("array", "string"))]
    assert flat.count() == 90 and sides.count() == 4  # "d" has players as team 1 alone
    assert flat.where("h2 is null").count() == games.where("team2 = 'd'").count() > 0


def test_results_travel_with_predictions(games, capsys):
    got = evaluation.chrono_scores(games, "elo").head()
    want = evaluation.chrono_metrics(evaluation.chrono_predictions(games, "elo"), games).head()
    assert got.n == want.n > 0 and got.nll == pytest.approx(want.nll, rel=1e-12) and got.accuracy == want.accuracy


def test_a_checkpoint_asks_once_for_games_that_no_model_tells_apart(games, monkeypatch):
    seen = []
    plain = evaluation._folded

    def folded(g, model, params, trials, asks=None):
        seen.append(asks)
        return plain(g, model, params, trials, asks)

    monkeypatch.setattr(evaluation, "_folded", folded)
    got = {(r.team, r.game_id): r.p for r in evaluation.new_team_predictions(games, "elo").collect()}
    first = evaluation.new_team_metadata(games)[0]
    pairs = evaluation.team_games(games, first).select("cp", "team1", "team2").distinct().count()
    assert seen[0].count() == pairs < len(got) == 180
    # each team's games from the state before its first
    from laddersmith.plans.registry import make

    order = folds.as_games(games.toPandas())
    when = {r.team: r.first_ts.timestamp() / 86400 for r in first.collect()}
    for r in evaluation.team_games(games, first).select("team", "flipped", "game_id").collect():
        m = make("elo")
        for x in order:
            if x.day < when[r.team]:
                m.update(x)
        p = m.predict(next(x for x in order if x.game_id == r.game_id))
        assert got[r.team, r.game_id] == pytest.approx(1 - p if r.flipped else p, abs=1e-12)


def test_history_is_rounded_before_it_is_expanded(spark):
    plan = catalog.queries()["elo_history"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("round(")


def test_a_document_by_stand_ins_is_that_of_all_players(spark):
    import json

    from laddersmith import fixtures
    from laddersmith.plans import export, history

    g, r = fixtures.games(spark, SF).where("game_id % 10 = 0"), fixtures.rosters(spark, SF)
    games, members = catalog._mates(spark, SF)
    games = games.where("game_id % 10 = 0")
    short = export.parts(history.sequential_history(games, "elo"), g, r, "elo", members=members)
    full = export.parts(history.sequential_history(catalog._full(spark, SF).where("game_id % 10 = 0"), "elo"), g, r, "elo")
    a, b = ({(x.kind, x.key): json.loads(x.json) for x in df.collect()} for df in (short, full))
    assert a.keys() == b.keys() and {k for k, _ in a} == {"metadata", "player", "team", "game"}
    for k, x in a.items():
        y = b[k]
        assert list(x) == list(y)
        for c, v in x.items():
            assert v == (pytest.approx(y[c], abs=0.011) if c in ("history", "current", "peak", "lowest") else y[c]), (k, c)


def test_tables_are_joined_once(spark):
    plan = catalog._mates(spark, SF)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "l_orderkey" not in plan


def test_games_share_what_is_known_of_their_sides():
    import pyarrow as pa

    sides = {"phase": [-1, -1], "h1": [7, 9], "h2": pa.array([None, None], pa.int64()), "marks": pa.array([None, None], pa.int32()), "team": ["a", "b"], "r": [[1, 2], [3]], "n": [[4, 1], [2]], "game_id": [0, 0]}
    played = {"phase": [1] * 3, "h1": [7, 9, 7], "h2": [9, 7, 9], "marks": pa.array([12] * 3, pa.int32()), "team": pa.array([None] * 3, pa.string()), "r": pa.array([None] * 3, pa.list_(pa.int64())), "n": pa.array([None] * 3, pa.list_(pa.int64())), "game_id": [1, 2, 3]}
    batches = [pa.RecordBatch.from_pydict(x | {"league": ["l"] * len(x["h1"]), "lane": [0] * len(x["h1"]), "segment": [0] * len(x["h1"])}) for x in (sides, played)]
    rows = [x[-1] for x in folds._read(iter(batches)) if x[1] > 0]
    assert [x.side(1) for x in rows] == [([1, 2], [4, 1], 5), ([3], [2], 2), ([1, 2], [4, 1], 5)]
    assert rows[0].side(1) is rows[1].side(2) is rows[2].side(1) and rows[0].side(2) is rows[1].side(1)


def test_elo_asks_once_for_a_game_that_it_learns_next():
    from laddersmith.operators.sequential import Elo, Game

    a, b = Elo(), Elo()
    for i in range(20):
        g = Game(i, 0.0, [1, 2 + i % 3], [7, 2 + (i + 1) % 3], i % 4, i % 3, n1=[3, 1], n2=[2, 2])
        p = a.predict(g)
        assert a.asked == (g, p) and p == b.predict(Game(-1, 0.0, g.r1, g.r2, 0, 0, n1=g.n1, n2=g.n2))
        a.update(g)
        b.update(g)  # asked of another game before
        assert a.asked is None and a.ratings == b.ratings


def test_edges_are_stars_of_their_partitions_first(spark, monkeypatch):
    from laddersmith.operators import graph

    path = spark.createDataFrame([(i, i + 1) for i in range(60) if i % 20 != 19], "a long, b long").coalesce(1)
    for held in (graph.HELD, 5):
        monkeypatch.setattr(graph, "HELD", held)
        lab = {r.node: r.label for r in graph.components(graph._stars(path)).collect()}
        assert lab == {i: i // 20 * 20 for i in range(60)}


def test_a_stretch_has_equal_games_of_all_before_it_once(games):
    from laddersmith.operators.folds import _dealt

    rows = _dealt(games, None, False, 5, False, 1).where("phase = 1").select("segment", "us", "game_id", "h1", "h2", "s1", "s2", F.col("marks").bitwiseAND(3).alias("kind"), (F.col("marks").bitwiseAND(8) != 0).alias("mine"), "times").collect()
    what = lambda r: (r.h1, r.h2, r.s1, r.s2, r.kind)
    own = [r for r in rows if r.mine]
    assert len(own) == 90 and len({r.segment for r in own}) == 5
    for k in range(5):
        before = sorted((r for r in own if r.segment < k), key=lambda r: (r.us, r.game_id))
        past = [r for r in rows if not r.mine and r.segment == k]
        assert len({what(r) for r in past}) == len(past)
        assert {what(r): r.times for r in past} == {w: sum(what(r) == w for r in before) for w in map(what, before)}
        assert all((r.us, r.game_id) == next((b.us, b.game_id) for b in before if what(b) == what(r)) for r in past)
