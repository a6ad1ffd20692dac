import math
import random

import numpy as np
import pytest

from laddersmith.functions.rating_math import phi
from laddersmith.operators import map_models as B
from laddersmith.operators import sequential as S


def games(n=60, players=12, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ps = rng.sample(range(players), 6)
        out.append(S.Game(i, float(i // 2), ps[:3], ps[3:], rng.randint(0, 6), rng.randint(0, 6), outcome_only=rng.random() < 0.2, tournament=rng.random() < 0.2))
    return out


def flip(g):
    return S.Game(g.game_id, g.day, g.r2, g.r1, g.s2, g.s1, outcome_only=g.outcome_only, tournament=g.tournament, on_court=g.on_court)


def test_elo_is_zero_sum_and_symmetric():
    a, b = S.Elo(), S.Elo()
    for g in games():
        assert a.predict(g) == pytest.approx(1 - b.predict(flip(g)))
        a.update(g)
        b.update(flip(g))
    assert sum(a.ratings.values()) == pytest.approx(1000 * len(a.ratings))
    assert S.Elo().predict(S.Game(0, 0, [], [1], 1, 0)) == 0.5


def test_elo_empty_side():
    m = S.Elo()
    m.update(S.Game(0, 0, [], [1, 2], 0, 3))
    assert m.ratings[1] == pytest.approx(1000 + 346.446 * 1.75 * 0.5 / 2)


@pytest.mark.parametrize("cls", [S.TrueSkill, S.TrueSkillMargin, S.ThroughTime])
def test_bayesian_updates(cls):
    m = cls()
    g = S.Game(0, 0.0, [1], [2], 2, 1 if cls is not S.TrueSkillMargin else 0, on_court=1)
    m.update(g)
    (m1, s1), (m2, s2) = m._get(1), m._get(2)
    assert m1 > m.mu > m2 and s1 < m.sigma and s2 < m.sigma
    assert m.predict(g) > 0.5
    assert m.predict(flip(g)) == pytest.approx(1 - m.predict(g))
    assert m.predict(S.Game(1, 0, [], [1], 0, 0)) == 0.5


def test_trueskill_against_quadrature():
    """Posterior moments of the winner of a two-player game, by integration."""
    m = S.TrueSkill(mu=25.0)
    var = m.sigma**2 + m.tau**2
    eps = S._quantile((m.draw + 1) / 2) * math.sqrt(2) * m.beta
    x = np.linspace(25 - 80, 25 + 80, 20001)
    other = math.sqrt(var + 2 * m.beta**2)
    like = np.array([phi((v - 25 - eps) / other) for v in x])
    w = like * np.exp(-((x - 25) ** 2) / (2 * var))
    mean = (w * x).sum() / w.sum()
    sd = math.sqrt((w * (x - mean) ** 2).sum() / w.sum())
    m.update(S.Game(0, 0, [1], [2], 1, 0, on_court=1))
    assert m._get(1) == pytest.approx((mean, sd), rel=1e-6)


def test_through_time_converges():
    m = S.ThroughTime(gamma=0.1)
    for g in games(40):
        m.update(g)
    before = dict(m.ratings)
    m.converge(force=True)
    assert set(m.curves) == set(before)
    # the last point of a curve has all games behind it: the filter's variance can't be smaller by much
    assert all(c[-1][2] <= before[p][1] * 1.05 for p, c in m.curves.items())
    fitted = m.fitted
    m.update(games(1)[0])
    m.converge()
    assert m.fitted == fitted  # too few new games
    one = S.ThroughTime(gamma=0.0)
    one.update(S.Game(0, 0.0, [1], [2], 1, 0, on_court=1))
    filtered = one.ratings[1]
    one.converge(force=True)
    assert one.curves[1][0][1:] == pytest.approx(filtered, rel=1e-9)
    inverted = S.ThroughTime(compat_inverted_result=True)
    inverted.update(S.Game(0, 0.0, [1], [2], 1, 0))
    assert inverted.ratings[1][0] < 25


@pytest.mark.parametrize("cls", [B.MarginBT, B.DecayBT, B.VetBT, B.UncertainBT, B.NormalBT])
def test_batch_fits(cls):
    gs = games()
    m = cls()
    for g in gs:
        m.update(g)
    m.converge()
    other = cls()
    for g in reversed(gs) if cls is not B.UncertainBT else gs:
        other.update(flip(g) if cls is not B.UncertainBT else g)
    other.converge()
    for g in gs[:10]:
        assert 0 < m.predict(g) < 1
        assert m.predict(g) == pytest.approx(other.predict(g), abs=1e-6)
        assert m.predict(flip(g)) == pytest.approx(1 - m.predict(g), abs=1e-9)
    if cls is B.NormalBT:
        t = np.array(list(m.theta.values()))
        assert m.tau**2 == pytest.approx(((t**2).sum() + 2 * m.b) / (len(t) + m.a), rel=1e-6)


def test_slopes_by_differences():
    rng = np.random.default_rng(1)
    gs = games(30)
    d = B.design(gs)
    y, m, on = B._facts(gs)
    f = B._probit(y, m, on, rng.uniform(1, 3, len(gs)), rng.uniform(1, 2, len(gs)))
    x, h = rng.normal(0, 2, len(gs)), 1e-5
    _, g, c = f(x)
    assert np.allclose((f(x + h)[0] - f(x - h)[0]) / (2 * h), g, atol=1e-6)
    assert np.allclose((f(x + h)[1] - f(x - h)[1]) / (2 * h), c, atol=1e-5)
    assert len(d.players) == 12


def test_margins_alone_are_ridge_regression():
    gs = [S.Game(i, 0.0, [i % 3], [(i + 1) % 3], i % 4 + 1, 0) for i in range(20)]
    m = B.VetBT(sigma0=1.0, beta=0.0, sigma=2.0)
    for g in gs:
        m.update(g)
    m.converge()
    d = B.design(gs)
    x = np.zeros((20, 3))
    x[d.row, d.col] = d.val
    want = np.linalg.solve(x.T @ x / 4 + 2 * np.eye(3), x.T @ np.array([g.s1 for g in gs]) / 4)
    assert [m.theta[p] for p in d.players] == pytest.approx(want.tolist(), abs=1e-7)


def test_skill_through_time_holds_what_games_share_once():
    sides = [[1, 2], [3], [2, 4]]
    m = S.ThroughTime(iterations=3)
    for i in range(300):
        m.update(S.Game(i, float(i // 4), sides[i % 3], sides[(i + 1) % 3], i % 2, 0))
    m.converge(force=True)
    assert len(m.known) == 6 and len(m.days) == len(m.forms) == 300
    assert not [v for v in vars(m).values() if isinstance(v, list) and len(v) > 6]  # nothing of a game is a Python object
    assert all(isinstance(x, np.ndarray) for x in m.points) and sum(map(len, m.curves.values())) == len(m.points[0])
    for p, c in m.curves.items():
        assert [m.rating_at(p, d) for d, _, _ in c[:1]] != [] and m.rating_at(p, c[-1][0] + 1) == c[-1][1:] == m._get(p)
        at = c[len(c) // 2][0]
        assert m.rating_at(p, at) == [x[1:] for x in c if x[0] <= at][-1]


def test_curves_are_learned_from_a_stream(spark):
    from laddersmith import catalog
    from laddersmith.plans import history

    plan = history.curves(catalog._mates(spark, "/root/testdata/sf0.001")[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
