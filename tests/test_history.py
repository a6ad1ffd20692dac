import pytest
from pyspark.sql import functions as F

from laddersmith import catalog
from laddersmith.plans import evaluation, history

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("model", ["elo", "trueskill", "ttt"])
def test_resume_equals_one_run(spark, model):
    g = catalog._full(spark, SF).where("game_id % 5 = 0").cache()
    cut = g.approxQuantile("day", [0.5], 0.0)[0]
    whole = history.sequential_history(g, model)
    state = history.snapshot(history.sequential_history(g.where(F.col("day") <= cut), model))
    rest = history.resume_history(g, state, model)
    want = {(r.game_id, r.player): r.rating for r in whole.where(F.unix_timestamp("ts") / 86400.0 > cut).collect()}
    got = {(r.game_id, r.player): r.rating for r in rest.collect()}
    assert want and all(got[k] == pytest.approx(v, rel=1e-9) for k, v in want.items())


def test_training_report(spark):
    g = catalog._full(spark, SF).cache()
    config = {"models": {"elo": {"defaults": {"initial_elo": 500.0, "tournament_multiplier": 1.25}, "search": {"K": {"type": "float", "low": 20.0, "high": 90.0, "log": True}}, "trials": 2}}}
    out = evaluation.train(g, config, "chrono")
    best = out["chrono"]["elo"]
    assert 20 <= best["params"]["K"] <= 90 and best["cross_mode"]["teams"] > 0
    # the search has run with the configured defaults
    again = evaluation.chrono_metrics(evaluation.chrono_predictions(g, "elo", best["params"]), g).head()
    assert best["metrics"]["nll"] == pytest.approx(again.nll, rel=1e-12) and best["params"]["tournament_multiplier"] == 1.25


def test_filled_by_those_who_stand_for_others(spark):
    from laddersmith.operators import intervals

    marks = spark.createDataFrame([(1, 10, 1.0), (1, 30, 2.0), (2, 20, 5.0), (4, 10, None)], "player long, us long, value double")
    members = spark.createDataFrame([(1, 1), (2, 2), (1, 3), (4, 4), (2, 7)], "stand long, player long")
    every = marks.withColumnRenamed("player", "stand").join(members, "stand").select("player", "us", "value")
    want = sorted(tuple(r) for r in intervals.filled(every, "player", width=2)[0].select("block", "us", "ratings").collect())
    for most in (3, 2):
        got = intervals.filled_for(marks, members, "player", F.col("ratings"), width=2, most=most)
        assert sorted(tuple(r) for r in got.select("block", "us", "ratings").collect()) == want


def test_dense_queries_fill_only_those_who_stand_for_others(spark, monkeypatch):
    from laddersmith.operators import intervals

    seen, filled = [], intervals.changes
    monkeypatch.setattr(intervals, "changes", lambda h, key: seen.append(h.select(key).distinct().count()) or filled(h, key))
    for q in (catalog.wide_rating_history, catalog.team_histories):
        q(spark, SF)
    assert seen and max(seen) <= catalog._mates(spark, SF)[1].select("stand").distinct().count()
