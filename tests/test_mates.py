"""Players who are in the same rosters throughout stand for one another."""

import random

import pytest
from pyspark.sql import functions as F

from laddersmith import catalog
from laddersmith.operators import folds, joins, mates, stats, stint
from laddersmith.operators.map_models import Ledger
from laddersmith.plans import batch_fit, evaluation, history

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def league(spark):
    rng = random.Random(3)
    rosters = [(f"t{t}", 100 * t + i) for t in range(4) for i in range(2 + t)] + [("t1", 1), ("t1", 201), ("t1", 202), ("t3", None), ("t5", 9)]
    games = [(i, i // 2, *(f"t{x}" for x in rng.sample(range(5), 2)), rng.randint(0, 4), rng.randint(0, 4), rng.random() < 0.2, rng.random() < 0.2) for i in range(60)]
    r = spark.createDataFrame(rosters, "team string, player long")
    g = spark.createDataFrame(games, "game_id long, s long, team1 string, team2 string, score1 int, score2 int, outcome_only boolean, tournament boolean")
    g = g.withColumn("ts", F.timestamp_seconds(F.col("s") * 400000)).drop("s")
    members = mates.mates(r)
    return r, g, members, folds.prepare(joins.with_rosters(g, r)).cache(), folds.prepare(mates.with_mates(g, r, members)).cache()


def _rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def _same(a, b, tol=1e-6):
    assert len(a) == len(b) > 0
    for x, y in zip(a, b, strict=True):
        assert x[:-1] == y[:-1] and x[-1] == pytest.approx(y[-1], abs=tol, rel=tol)


def test_games_of_the_tables_carry_no_rosters(spark):
    games, members = catalog._mates(spark, SF)
    longest = games.agg(F.max(F.size("r1"))).head()[0]
    assert longest < catalog._full(spark, SF).agg(F.max(F.size("r1"))).head()[0] / 2
    assert members.count() == spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").distinct().count()


def test_a_league_of_any_size_takes_one_entry_a_roster(spark):
    r = spark.range(2000).select(F.concat(F.lit("t"), (F.col("id") % 2).cast("string")).alias("team"), F.col("id").alias("player"))
    g = spark.createDataFrame([(1, "t0", "t1")], "game_id long, team1 string, team2 string")
    row = mates.with_mates(g, r, mates.mates(r)).head()
    assert (row.r1, row.n1, row.r2, row.n2) == ([0], [1000], [1], [1000])


@pytest.mark.parametrize("model", ["elo", "trueskill", "trueskill_mov", "ttt", "bt_mov", "bt_mov_time_decay", "bt_vet", "bt_uncert", "bt_normal"])
def test_histories_agree_with_whole_rosters(league, model):
    _, _, members, full, short = league
    cols = ("ts", "player", "rating")
    _same(_rows(history.run_model(full, model), *cols), _rows(history.run_model(short, model, members=members), *cols), 1e-4)


@pytest.mark.parametrize("model", ["elo", "trueskill", "trueskill_mov", "ttt", "bt_mov", "bt_uncert"])
def test_predictions_agree_with_whole_rosters(league, model):
    _, _, _, full, short = league
    _same(_rows(evaluation.chrono_predictions(full, model), "game_id", "p"), _rows(evaluation.chrono_predictions(short, model), "game_id", "p"))


@pytest.mark.parametrize("model", ["bt_mov", "bt_mov_time_decay", "bt_vet"])
def test_fits_agree_with_whole_rosters(league, model):
    _, _, members, full, short = league
    _same(_rows(batch_fit.batch_ratings(full, model), "player", "theta"), _rows(mates.everyone(batch_fit.batch_ratings(short, model), members), "player", "theta"))


def test_stint_coefficients_agree_with_whole_rosters(league):
    _, _, members, full, short = league
    _same(_rows(stint.fit(full, folds=2)[0], "feature", "mean"), _rows(stint.for_everyone(stint.fit(short, folds=2)[0], members), "feature", "mean"), 1e-3)


def test_sample_sizes_agree_with_whole_rosters(league):
    r, g, members, _, _ = league
    ess = lambda x: stats.effective_sample_size(stats.outcome_series(g, x), "player", ["ts", "game_id", "side", "team"], "x")
    want = ess(r.where("player is not null"))
    _same(_rows(want, "player", "n", "ess"), _rows(mates.everyone(ess(mates.stands(r, members)), members), "player", "n", "ess"))


def test_roster_sums_need_no_arrays(league):
    r, g, _, full, _ = league
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    assert _rows(joins.with_roster_sums(g, r), "game_id", "n1", "n2", "sum1", "sum2") == _rows(full.select("game_id", F.size("r1"), F.size("r2"), total("r1"), total("r2")), "*")


def test_a_ledger_of_equal_games_has_one_row(spark):
    d = Ledger(merge=True, decay=0.9)
    for i in range(50):
        d.add(folds.Game(i, 7.0 * i * 100, [1, 2], [3], 2, 1, n1=[3, 4], n2=[1]))
    assert len(d) == 1 and d.times.view().tolist() == [50] and d.size == 8
    assert d.aged()[0] == pytest.approx(sum(0.9 ** (100 * k) for k in range(50)))


def test_trials_share_the_stream_of_games(league):
    short = league[-1]
    spec = {"k": {"low": 50.0, "high": 500.0}}
    t = evaluation.sample_trials(short.sparkSession, spec, 7)
    got = evaluation.chrono_predictions(short, "elo", trials=t)
    assert got.groupBy("trial_id").count().where(F.col("count") == 60).count() == 7
    one = t.where("trial_id = 5")
    assert _rows(got.where("trial_id = 5"), "game_id", "p") == _rows(evaluation.chrono_predictions(short, "elo", trials=one), "game_id", "p")
