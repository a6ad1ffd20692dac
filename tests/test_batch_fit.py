"""Fits over partitions against the fit of all games in one process."""

import random
from datetime import datetime, timedelta

import pytest

from laddersmith.operators.folds import as_games
from laddersmith.plans import batch_fit
from laddersmith.plans.registry import BATCH, make

SCHEMA = "game_id long, ts timestamp, day double, team1 string, team2 string, r1 array<long>, r2 array<long>, s1 int, s2 int, outcome_only boolean, tournament boolean"


def games_of(spark, n=70, seed=3):
    """Draws, scores that can't be read, outcomes alone, tournaments, no time, empty rosters, players on both sides, repeats in a roster."""
    rng, rows = random.Random(seed), []
    teams = {f"T{k}": [rng.randrange(1, 14) for _ in range(rng.randrange(1, 4))] for k in range(7)}
    for i in range(n):
        a, b = rng.sample(sorted(teams), 2)
        ts = None if i % 17 == 5 else datetime(2024, 1, 1) + timedelta(days=rng.randrange(200))
        r1 = [] if i % 23 == 7 else list(teams[a]) + [rng.randrange(1, 14)][: i % 2]
        r2 = list(teams[b]) + ([r1[0]] if i % 9 == 4 and r1 else [])
        s = [None if i % 19 == 3 else rng.randrange(0, 6) for _ in range(2)]
        rows.append((i, ts, None if ts is None else (ts - datetime(1970, 1, 1)).total_seconds() / 86400, a, b, r1, r2, *s, i % 5 == 0, i % 7 == 0))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("model", sorted(BATCH))
def test_equal_to_the_fit_in_one_process(spark, model):
    games = games_of(spark)
    # a ridge that makes the least loss sharp enough to be compared
    params = {"lam": 0.05} if model == "bt_uncert" else {"nu": 0.3} if model == "bt_mov_time_decay" else {}
    one = make(model, params)
    for g in as_games(games.toPandas()):
        one.update(g)
    one.converge()
    want = {p: (t, r) for p, t, r in zip(*one.table(), strict=True)}
    got = {r.player: (r.theta, r.rating) for r in batch_fit.batch_ratings(games, model, params).collect()}
    assert set(got) == set(want)
    for p in want:
        assert got[p] == pytest.approx(want[p], abs=1e-5, rel=1e-6)


def test_nothing_to_fit(spark):
    assert batch_fit.batch_ratings(games_of(spark).where("game_id < 0"), "bt_mov").count() == 0
    none = games_of(spark).selectExpr("game_id", "ts", "day", "team1", "team2", "slice(r1, 1, 0) AS r1", "slice(r2, 1, 0) AS r2", "s1", "s2", "outcome_only", "tournament")
    assert batch_fit.batch_ratings(none, "bt_mov").count() == 0


def test_games_are_packed_once_whatever_the_partitions(spark):
    """What is shuffled grows with the games alone; sums don't depend on how they are dealt."""
    import numpy as np
    from pyspark.sql import functions as F

    games, model = games_of(spark), make("bt_mov")
    who = sorted({p for r in games.collect() for p in [*r.r1, *r.r2]})
    index = spark.createDataFrame([(p, k) for k, p in enumerate(who)], "player long, at int")
    theta, kept, sums = np.linspace(-1, 1, len(who)), spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in ("2", "24"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            blocks = batch_fit.packed(games, "bt_mov", model, index, None)
            cells = blocks.agg(F.sum(F.length("at")), F.sum(F.length("sizes"))).head()
            assert cells[0] == 4 * batch_fit.occurrences(games, False).count() and cells[1] == 4 * games.where("size(r1) + size(r2) > 0").count()
            sums.append(batch_fit.Sums(blocks, len(who), model).slope(theta))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert sums[0][0] == pytest.approx(sums[1][0], rel=1e-12)
    assert np.allclose(sums[0][1], sums[1][1], atol=1e-10) and np.allclose(sums[0][2], sums[1][2], atol=1e-10)


def test_too_many_players_are_refused(spark, monkeypatch):
    monkeypatch.setattr(batch_fit, "MOST", 3)
    with pytest.raises(ValueError, match="players"):
        batch_fit.batch_ratings(games_of(spark), "bt_mov")
