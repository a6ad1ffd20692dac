"""Lanes of sequential models: the same steps as the models', by place."""

import random

import pytest

from laddersmith.operators import sequential as S


@pytest.mark.parametrize("cls", [S.Elo, S.TrueSkill, S.TrueSkillMargin])
def test_lanes_say_what_models_say(cls):
    rng = random.Random(5)
    rosters = [[], [1, 2], [2, 3, 4], [5], [1, 6, 7, 8, 9, 10], [11, 12]]
    counts = [[], [3, 1], [1, 1, 2], [9], [1] * 6, [2, 2]]
    m, places, sides = cls(), {}, []
    lane = cls().lane(places, sides)
    for r, n in zip(rosters, counts, strict=True):
        for p in r:
            places.setdefault(p, len(places))
        sides.append(([places[p] for p in r], n, sum(n)))
        lane.grow()
    for i in range(400):
        a, b = rng.randrange(6), rng.randrange(6)
        s1, s2, known, only, cup, court = rng.randint(0, 4), rng.randint(0, 4), rng.random() < 0.9, rng.random() < 0.2, rng.random() < 0.2, rng.choice([2, 8])
        g = S.Game(i, float(i), rosters[a], rosters[b], s1, s2, known, only, cup, court, n1=counts[a], n2=counts[b])
        p = lane.predict(a, b, court)
        assert p == pytest.approx(m.predict(g), rel=1e-12)
        m.update(g)
        lane.learn(a, b, s1, s2, known, only, cup, court, p if rng.random() < 0.5 else None)
        for x, k in places.items():
            assert lane.shown(k)[0] == pytest.approx(m.expose(x), rel=1e-9, abs=1e-9)


def test_skill_through_time_keeps_no_arrays_for_a_game():
    """A sweep's cost is a game's few numbers; its results are those of messages one by one."""
    rng, m = random.Random(2), S.ThroughTime(iterations=2)
    rosters = [[1, 2], [2, 3, 4], [5], [6, 1]]
    for i in range(60):
        a, b = rng.sample(range(4), 2)
        m.update(S.Game(i, float(i // 3), rosters[a], rosters[b], rng.randint(0, 2), rng.randint(0, 2), n1=[2] * len(rosters[a]), n2=None))
    places = m.known[0][1]
    assert isinstance(places, list) and all(isinstance(x, int | float) for p in places for x in p)
    forms, days = list(m.forms), list(m.days)
    slots = [(i, p) for i, f in enumerate(forms) for p in m.known[f][0]]
    msg, ahead, behind = ({x: (0.0, 0.0) for x in slots} for _ in range(3))

    def way(order, mine, other, first):
        run, seen = {}, {}
        for i in order:
            own, places, margin, draw = m.known[forms[i]][:4]
            now = []
            for p in own:
                pi, tau = run.get(p, first)
                if p in seen and pi > 0:
                    wide = 1 / pi + abs(days[i] - seen[p]) * m.gamma**2
                    pi, tau = 1 / wide, tau / pi / wide
                now.append((pi, tau))
            q = [(pi + other[i, p][0], tau + other[i, p][1]) for p, (pi, tau) in zip(own, now, strict=True)]
            out = m._messages([t / x for x, t in q], [1 / x for x, _ in q], places, margin, draw)
            for p, (pi, tau), x, y in zip(own, now, *out, strict=True):
                mine[i, p], msg[i, p], run[p], seen[p] = (pi, tau), (x, y), (pi + x, tau + y), days[i]

    prior = (1 / m.sigma**2, m.mu / m.sigma**2)
    for _ in range(2):
        way(range(60), ahead, behind, prior)
        way(range(59, -1, -1), behind, ahead, (0.0, 0.0))
    m.converge(force=True)
    run, seen, want = {}, {}, {}
    for i, p in slots:
        pi, tau = run.get(p, prior)
        if p in seen:
            wide = 1 / pi + (days[i] - seen[p]) * m.gamma**2
            pi, tau = 1 / wide, tau / pi / wide
        run[p], seen[p] = (pi + msg[i, p][0], tau + msg[i, p][1]), days[i]
        want.setdefault(p, []).append((run[p][1] + behind[i, p][1]) / (run[p][0] + behind[i, p][0]))
    for p, means in want.items():
        assert [x[1] for x in m.curves[p]] == pytest.approx(means, rel=1e-9)


def test_fading_games_reach_a_stretch_as_one_row(spark):
    from pyspark.sql import functions as F

    from laddersmith.operators import folds
    from laddersmith.plans import evaluation, history
    from laddersmith.plans.registry import decay

    assert decay("bt_mov_time_decay", {"decay_base": 0.9}) == 0.9 and decay("bt_mov_time_decay", {"decay": 0.0}) is None and decay("bt_mov") is None
    rng = random.Random(4)
    rows = [(i, i // 2, *((["a"], ["b"]) if rng.random() < 0.5 else (["b"], ["c"])), rng.randint(0, 1), rng.randint(0, 1)) for i in range(80)]
    g = spark.createDataFrame(rows, "game_id long, s long, r1 array<string>, r2 array<string>, score1 int, score2 int")
    g = g.withColumn("ts", F.timestamp_seconds(F.col("s") * 300000)).drop("s").withColumn("team1", F.col("r1")[0]).withColumn("team2", F.col("r2")[0])
    g = folds.prepare(g.withColumn("outcome_only", F.lit(False)).withColumn("tournament", F.lit(False))).cache()
    # 2 pairs with 4 scores: no more rows a stretch, whatever the dates
    past = folds._dealt(g, None, True, 4, True, 1, 0.9).where("phase = 1 and marks & 8 = 0").groupBy("segment").count().collect()
    assert len(past) == 3 and all(r["count"] <= 8 for r in past)
    whole = folds._dealt(g, None, True, 4, True, 1).where("phase = 1 and marks & 8 = 0").groupBy("segment").count()
    assert whole.agg(F.max("count")).head()[0] > 8
    params = {"decay": 0.9}
    one = lambda df, v: {tuple(r)[:-1]: r[-1] for r in df.select(*v).collect()}
    want = folds.fold(g, lambda p: history.make("bt_mov_time_decay", params | p), ratings=True, shared=True, segments=1)
    got = history.batch_history(g, "bt_mov_time_decay", params)
    want, got = one(want, ("ts", "player", "rating")), one(got, ("ts", "player", "rating"))
    assert want.keys() == got.keys() and all(got[k] == pytest.approx(v, rel=1e-8) for k, v in want.items())
    p = one(evaluation.chrono_predictions(g, "bt_mov_time_decay", params), ("game_id", "p"))
    q = one(folds.fold(g, lambda p: history.make("bt_mov_time_decay", params | p), shared=True, segments=1), ("game_id", "p"))
    assert p.keys() == q.keys() and all(p[k] == pytest.approx(v, abs=1e-7) for k, v in q.items())
