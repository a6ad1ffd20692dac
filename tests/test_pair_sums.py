"""Sums over all pairs by interpolation, against their definition."""

import numpy as np
import pytest

from laddersmith.functions.pair_sums import PairSums, Standing, all_pairs
from laddersmith.operators.stats import head_to_head


@pytest.mark.parametrize(("spread", "least", "most", "sigma"), [(3.0, 0.1, 1.0, 4.2458), (30.0, 0.0, 2.0, 4.2458), (5.0, 0.01, 0.9, 0.5), (0.0, 1.0, 1.0, 1.0), (1.0, 0.0, 40.0, 2.0)])
def test_means_over_pairs_are_within_a_millionth(spread, least, most, sigma):
    rng = np.random.default_rng(4)
    x, v = rng.normal(0, 1, 700) * spread, rng.uniform(least, most, 700)
    fast = PairSums(x.min(), x.max(), v.min(), v.max(), sigma)
    halves = fast.moments(x[:200], v[:200]) + fast.moments(x[200:], v[200:])  # moments of parts add up
    got, want = fast.sums(x, v, fast.curve(halves)), all_pairs(x, v, sigma)
    assert np.abs(got - want).max() / len(x) < 1e-9


def test_a_standing_set_follows_its_players():
    rng = np.random.default_rng(5)
    x, v, s = rng.normal(0, 2, 3000), rng.uniform(0.2, 1, 3000), Standing(4.2458)
    for _ in range(4):
        assert np.abs(s.sums(x, v) - all_pairs(x, v, 4.2458)).max() / len(x) < 1e-9
        x, v = x + rng.normal(0, 0.3, len(x)), v * rng.uniform(0.9, 1.1, len(v))
    assert np.abs(s.sums(x[:7], v[:7]) - all_pairs(x[:7], v[:7], 4.2458)).max() < 1e-9


def test_points_do_not_grow_with_the_players():
    assert PairSums(-10, 10, 0.1, 1, 4.2458).points < 1500


def test_head_to_head_is_every_pair(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(rng.normal(0, 3)), float(rng.uniform(0.1, 1)), i % 9 != 0) for i in range(400)]
    rows += [(900, None, 1.0, None), (901, rows[1][1], rows[1][2], True)]  # unknown activity counts as none; ties are players
    got = {r.player: r.rating for r in head_to_head(spark.createDataFrame(rows, "player long, theta double, sigma double, active boolean")).collect()}
    act = [r for r in rows if r[3]]
    want = (all_pairs(np.array([r[1] for r in act]), np.array([r[2] ** 2 for r in act]), 4.2458) - 0.5) / (len(act) - 1) * 2000
    assert {r[0]: got[r[0]] for r in act} == pytest.approx({r[0]: w for r, w in zip(act, want, strict=True)}, abs=1e-5)
    assert all(got[r[0]] == 1000 for r in rows if not r[3]) and len(got) == len(rows)


def test_head_to_head_of_one_and_none(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, True), (2, 0.0, 1.0, False)], "player long, theta double, sigma double, active boolean")
    assert {r.player: r.rating for r in head_to_head(df).collect()} == {1: 2000.0, 2: 1000.0}
    assert head_to_head(df.where("false")).count() == 0
