"""Parzen search against random search, its batches, its values."""

import math
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from laddersmith.plans import adaptive, evaluation
from test_batch_fit import games_of

SPEC = {"x": {"type": "float", "low": -5.0, "high": 5.0}, "lam": {"type": "float", "low": 1e-6, "high": 1.0, "log": True}, "n": {"type": "int", "low": 2, "high": 20, "step": 3}, "how": {"choices": ["a", "b", "c"]}}


def objective(p):
    return (p["x"] - 1.7) ** 2 + (math.log10(p["lam"]) + 3) ** 2 + abs(p["n"] - 11) / 6 + {"a": 1.0, "b": 0.0, "c": 2.0}[p["how"]]


def run(seed, trials, batch, adaptively):
    rng, done = random.Random(seed), []
    while len(done) < trials:
        now = []
        for _ in range(batch):
            now.append(adaptive.propose(rng, SPEC, done if adaptively else [], now, evaluation.sample_param))
        done += [(p, objective(p)) for p in now]
    return done


def test_better_than_random_at_as_many_trials():
    for batch in (1, 8):
        best = [[min(y for _, y in run(seed, 64, batch, how)) for seed in range(15)] for how in (True, False)]
        assert median(best[0]) < 0.6 * median(best[1])


def test_values_keep_to_their_specification():
    for p, _ in run(3, 80, 8, True):
        assert -5 <= p["x"] <= 5 and 1e-6 <= p["lam"] <= 1 and p["n"] in range(2, 21, 3) and p["how"] in ("a", "b", "c")
    one = {"k": {"low": 3.0, "high": 3.0}}
    done = [({"k": 3.0}, float("nan") if i % 2 else math.inf) for i in range(12)]
    assert adaptive.propose(random.Random(1), one, done, [], evaluation.sample_param) == {"k": 3.0}


def test_densities_sum_to_one():
    d = adaptive.Bells([0.2, 0.21, 0.9, 1.0, 1.0], 0.0, 1.0)
    xs = [(i + 0.5) / 20000 for i in range(20000)]
    assert sum(math.exp(d.log(x)) for x in xs) / 20000 == pytest.approx(1, abs=1e-4)


def test_search_in_batches_is_reproducible(spark):
    games = games_of(spark, 40).withColumn("on_court", F.lit(8))
    spec = {"k": {"low": 20.0, "high": 800.0, "log": True}, "tournament_factor": {"low": 1.0, "high": 2.0}}
    got = [evaluation.search(games, "elo", spec, 14, sampler="tpe", batch=6).orderBy("trial_id").collect() for _ in range(2)]
    assert [r.trial_id for r in got[0]] == list(range(14)) and got[0] == got[1]
    first = evaluation.sample_trials(spark, spec, 12).collect()  # the batches that begin before enough results are in are random ones
    assert [r.params for r in got[0][:12]] == [r.params for r in first] and got[0][12].params != got[0][13].params
    alone = evaluation.chrono_metrics(evaluation.chrono_predictions(games, "elo", {k: float(v) for k, v in got[0][13].params.items()}), games).head()
    assert got[0][13].objective == pytest.approx(alone.nll, rel=1e-12)
    with pytest.raises(ValueError):
        evaluation.search(games, "elo", spec, 2, sampler="grid")


def test_batches_share_one_stream_of_games(spark, monkeypatch):
    from laddersmith.operators import folds

    made, plain = [], folds._dealt
    monkeypatch.setattr(folds, "_dealt", lambda *a: made.append(plain(*a)) or made[-1])
    games = games_of(spark, 40).withColumn("on_court", F.lit(8))
    spec = {"k": {"low": 20.0, "high": 800.0, "log": True}}
    got = evaluation.search(games, "elo", spec, 12, sampler="tpe", batch=4).orderBy("trial_id").collect()
    assert len(made) == 1 and len(got) == 12 and not made[0].storageLevel.useDisk  # freed when the last batch is done
    alone = evaluation.chrono_scores(games, "elo", {"k": float(got[11].params["k"])}).head()
    assert got[11].objective == pytest.approx(alone.nll, rel=1e-12)
