"""Batch fits pass over pairs of sides, not over games."""

import random

import numpy as np
import pytest

from laddersmith.operators.map_models import Pooled, design, minimise
from laddersmith.operators.sequential import Game
from laddersmith.plans.registry import make

SIDES = [[1, 2], [2, 3, 4], [5], [1, 5, 6], []]


@pytest.mark.parametrize("model", ["bt_mov", "bt_vet", "bt_uncert", "bt_mov_time_decay"])
def test_a_fit_by_pairs_is_that_by_games(model):
    rng = random.Random(2)
    games = [Game(i, 3.0, *rng.sample(SIDES, 2), rng.randint(0, 4), rng.randint(0, 4), outcome_only=rng.random() < 0.3) for i in range(300)]
    m = make(model, {"nu": 0.2} if model == "bt_mov_time_decay" else {"lam": 0.05} if model == "bt_uncert" else {})
    for g in games:
        m.update(g, ("a", "b")) if model == "bt_uncert" else m.update(g)
    m.converge()
    d = design(games, m.REPLACE)
    y, margin, on = d.facts()
    noise = None if model == "bt_mov_time_decay" else m.noise_of_all() if model == "bt_mov" else np.array([m.noise(g) if model == "bt_uncert" else m.noise_of_all() for g in games])
    w = 1 + np.log1p(np.abs(margin)) if model == "bt_mov_time_decay" else np.ones(len(games))
    ridge = m.ridge(d.appearances()) if model == "bt_vet" else np.full(len(d.players), m.lam)
    want = minimise(d, m.terms(y, margin, on, noise, w), ridge, np.zeros(len(d.players)))
    assert m.values == pytest.approx(want, abs=1e-6)


def test_rows_of_a_fit_are_the_pairs_that_met():
    m = make("bt_mov")
    for i in range(500):
        m.update(Game(i, float(i), *(SIDES[k] for k in ((0, 1), (1, 2), (2, 3))[i % 3]), i % 7, i % 4))
    assert len(Pooled(m.ledger).dot(np.zeros(6))) == 3 and m.ledger.tallies()[[0, 1, 4, 5, 6]].sum() == 500
