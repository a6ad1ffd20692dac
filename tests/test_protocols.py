"""The back-tests' rules: unreadable rows, and convergence at checkpoints."""

import random

import pytest
from pyspark.sql import functions as F

from laddersmith.operators import folds
from laddersmith.plans import evaluation
from laddersmith.plans.registry import MODELS, make

SCHEMA = "game_id long, s long, team1 string, team2 string, r1 array<long>, r2 array<long>, s1 int, s2 int, outcome_only boolean, tournament boolean, on_court int"
#: Two leagues without a common player; E has no players.
TEAMS = {t: [k * 3 + i for i in range(3)] for k, t in enumerate("abcdwxyz")} | {"e": []}


def rows(n=90, seed=8):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        known = 2 + i // 22  # teams come one after another
        league = rng.choice(["abcd"[:known], "wxyz"[:known]])
        a, b = rng.sample([*league], 2)
        if i % 13 == 0:
            b = "e"
        out.append((i, 86400 * (i // 2), a, b, TEAMS[a], TEAMS[b], rng.randint(0, 5), rng.randint(0, 5), rng.random() < 0.2, False, 2))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA).withColumn("ts", F.timestamp_seconds("s")).withColumn("day", F.col("s") / 86400.0).withColumn("score1", F.col("s1")).withColumn("score2", F.col("s2"))


@pytest.mark.parametrize("model", list(MODELS))
def test_chronological_passes_over_unreadable_rows(spark, model):
    data = rows(40)
    bad = [(500 + i, 86400 * d, "a", "b", TEAMS["a"], TEAMS["b"], s1, s2, only, False, 2) for i, (d, s1, s2, only) in enumerate([(0, None, None, True), (3, None, 4, False), (5, 3, None, True), (9, None, None, False)])]
    bare, mixed = ({r.game_id: r.p for r in evaluation.chrono_predictions(frame(spark, x), model).collect()} for x in (data, [*bad, *data]))
    assert mixed.keys() == bare.keys() and len(bare) == 40
    assert mixed == pytest.approx(bare, abs=1e-6)


@pytest.mark.parametrize("least", [1, 10, 25])
def test_skill_through_time_converges_at_checkpoints(spark, least):
    """All leagues in one model that converges at each checkpoint, against streams of leagues."""
    df = frame(spark, rows()).cache()
    params = {"min_new_games": least, "gamma": 0.2}
    got = {(r.team, r.game_id, r.flipped): r.p for r in evaluation.new_team_predictions(df, "ttt", params).collect()}
    order = folds.as_games(df.toPandas())
    first = {}
    for g in order:
        for t in g.teams:
            first.setdefault(t, g.day)
    m, fed, want, fits = make("ttt", params), 0, {}, set()
    for at in sorted(set(first.values())):
        while fed < len(order) and order[fed].day < at:
            m.update(order[fed])
            fed += 1
        m.converge()
        fits.add(m.fitted)
        for g in order:
            for t, flipped in zip(g.teams, (False, True), strict=True):
                if first[t] == at:
                    p = m.predict(g)
                    want[t, g.game_id, flipped] = 1 - p if flipped else p
    assert len(fits - {0}) > (least < 25)  # it did converge, and more than once if few games are enough
    assert got == pytest.approx(want, abs=1e-6)


def test_checkpoints_of_no_games(spark):
    df = frame(spark, rows()).where("false")
    assert evaluation.new_team_predictions(df, "ttt").count() == 0
