"""Rating histories: every player's rating after every game."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laddersmith.operators import intervals
from laddersmith.operators.folds import as_games, fold, learned, player_type
from laddersmith.operators.graph import player_leagues
from laddersmith.operators.mates import everyone
from laddersmith.operators.order import numbered
from laddersmith.operators.stats import compare_ratings
from laddersmith.plans.registry import DATED, SEQUENTIAL, SHARED, decay, make
from laddersmith.session import materialize, ship


def sequential_history(games: DataFrame, model: str, params: dict | None = None) -> DataFrame:
    """(ts, game_id, player, rating, mu, sigma): changes only; of games at one time the last counts."""
    return fold(games, lambda p: make(model, dict(params or {}) | p), ratings=True).drop("trial_id")


def curves(games: DataFrame, params: dict | None = None) -> DataFrame:
    """(player, day, mu, sigma, dated): learning curves of skill through time after convergence, league by league.

    Games without a time stand on days of their own, which aren't ``dated``."""
    def make_one(_: dict):
        return make("ttt", params)

    return learned(games, make_one, _curve, f"player {player_type(games)}, day double, mu double, sigma double, dated boolean")


def _curve(m, dated: set):
    """(player, day, mu, sigma, dated) of all curves after convergence, some points at a time."""
    m.converge(force=True)
    for p, (lo, hi) in m.spans.items():
        for i in range(lo, hi, 10_000):
            days, mu, sigma = (x[i : min(hi, i + 10_000)].tolist() for x in m.points)
            yield [p] * len(days), days, mu, sigma, [d in dated for d in days]


def curve_ratings(games: DataFrame, params: dict | None = None) -> DataFrame:
    """(ts, player, rating, mu, sigma) of the converged curves, at the times when a player played."""
    m = make("ttt", params)
    c = curves(games, params).withColumn("ts", F.when(F.col("dated"), F.timestamp_seconds(F.round(F.col("day") * 86400))))
    return c.select("ts", "player", ((F.col("mu") - 3 * F.col("sigma")) * (1000.0 / m.mu)).alias("rating"), "mu", "sigma")


def dense(history: DataFrame, players: DataFrame, default: float) -> DataFrame:
    """(ts, player, rating) of every player at every time of a history of changes: the last rating at or before it, else ``default``."""
    return intervals.long(*intervals.filled(intervals.changes(history, "player"), "player", players, default), "player")


def seeds(games: DataFrame, rosters: DataFrame, start: float) -> DataFrame:
    """(ts, player, rating): a row for every player of the rosters 20 minutes before the first game."""
    first = games.agg((F.min("ts") - F.expr("INTERVAL 20 MINUTES")).alias("ts")).where("ts is not null")
    return rosters.select("player").where("player is not null").distinct().crossJoin(F.broadcast(first)).select("ts", "player", F.lit(start).alias("rating"))


def team_histories(history: DataFrame, rosters: DataFrame, default: float = 1000.0, counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``counted`` (team, player, n), if given, says which of the history's players count in a team, and for how many. The mean rating of each team's members at every time of the history, as intervals.filled() has it; a team none of whose members has any rating has the default throughout."""
    marks = materialize(intervals.changes(history, "player"), "team-histories")
    return intervals.filled(_at_all_times(intervals.group_changes(marks, rosters if counted is None else counted, "player", "team"), marks), "team", rosters, default)


def _at_all_times(own: DataFrame, marks: DataFrame) -> DataFrame:
    """``own`` with rows of no entity at the times that it lacks."""
    return own.unionByName(marks.select(F.lit(None).cast(own.schema["team"].dataType).alias("team"), "us", F.lit(None).cast("double").alias("value")).distinct())


def batch_history(games: DataFrame, model: str, params: dict | None = None, after: int | None = None) -> DataFrame:
    """(ts, game_id, player, theta, rating): every known player after a fit of all games up to each time; of games at one time the last counts.

    Leagues share no player, so each fits alone; models whose scale or reference time is common to all fit all together. Each fit starts from the
    one before, and stretches of time are parallel tasks. With ``after`` (microseconds) the times behind it alone.
    """
    h = fold(games, lambda p: make(model, dict(params or {}) | p), ratings=True, shared=model in SHARED, segments=games.sparkSession.sparkContext.defaultParallelism, after=after, dated=model in DATED, decay=decay(model, params))
    return h.select("ts", "game_id", "player", F.col("mu").alias("theta"), "rating")


def resume(games: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Games after the last one that the snapshot has."""
    last = snapshot.agg(F.max(F.unix_micros("ts"))).head()[0]
    return games if last is None else games.where(F.unix_micros("ts") > last)


def snapshot(history: DataFrame) -> DataFrame:
    """(player, ts, mu, sigma): the last state of each player, in full precision. Elo's rating stands in mu."""
    last = history.groupBy("player").agg(F.max_by(F.struct("ts", "rating", "mu", "sigma"), F.struct(F.col("ts").isNull(), "ts", "game_id")).alias("s"))
    return last.select("player", "s.ts", F.coalesce("s.mu", "s.rating").alias("mu"), "s.sigma")


def resume_history(games: DataFrame, state: DataFrame, model: str, params: dict | None = None) -> DataFrame:
    """(ts, game_id, player, rating, mu, sigma) of the games after the snapshot ``state``, going on from it.

    Batch models learn from all games again (a fit has no state that stands for them), but fit only after the snapshot.
    """
    ship(games.sparkSession)
    if model not in SEQUENTIAL:
        last = state.agg(F.max(F.unix_micros("ts"))).head()[0]
        h = batch_history(games, model, params, last)
        return h.select("ts", "game_id", "player", "rating", F.col("theta").alias("mu"), F.lit(None).cast("double").alias("sigma"))
    new = resume(games, state)
    g = new.join(player_leagues(new), "game_id")
    who = g.select("league", F.explode(F.concat("r1", "r2")).alias("player")).distinct()
    known = who.join(state, "player").select(F.col("league").alias("own_league"), "player", "mu", "sigma", (F.unix_timestamp("ts") / 86400.0).alias("day"))

    def run(pdf: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        m = make(model, params)
        for r in old.itertuples():
            m.ratings[r.player] = r.mu if model == "elo" else (r.mu, r.sigma)
            if hasattr(m, "last_day"):
                m.last_day[r.player] = r.day
        out = []
        for x in as_games(pdf) if len(pdf) else []:
            m.update(x)
            for p in sorted({*x.r1, *x.r2}):
                mu, sigma = m._get(p) if hasattr(m, "_get") else (m.expose(p), None)
                out.append((x.game_id, p, m.expose(p), mu, sigma))
        return pd.DataFrame(out, columns=["game_id", "player", "rating", "mu", "sigma"])

    h = g.groupBy("league").cogroup(known.groupBy("own_league")).applyInPandas(run, f"game_id long, player {player_type(games)}, rating double, mu double, sigma double")
    return h.join(new.select("game_id", "ts"), "game_id")


def run_model(games: DataFrame, model: str, params: dict | None = None, rosters: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """The history of any model, long (ts, player, rating): sequential models by fold, skill through time by its converged curves, batch models
    by a fit after each time. With ``rosters``, a first row for every player before the first game. ``members``: whom the games' players stand for (mates.py)."""
    h = curve_ratings if model == "ttt" else lambda g, p: (sequential_history if model in SEQUENTIAL else batch_history)(g, model, p)
    out = h(games, params).select("ts", "player", "rating")
    out = out if members is None else everyone(out, members)
    if rosters is None:
        return out
    start = 0.0 if model in ("trueskill", "trueskill_mov", "ttt") else make(model, params).initial if model == "elo" else 1000.0
    return out.unionByName(seeds(games, rosters, start))


def forward_against_converged(games: DataFrame, params: dict | None = None, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Skill through time: the players whose mean after the filtering pass differs most from the converged one, and the summary of all."""
    forward = snapshot(sequential_history(games, "ttt", params)).select("player", F.col("mu").alias("rating"))
    last = curves(games, params).groupBy("player").agg(F.max_by("mu", "day").alias("rating"))
    return compare_ratings(forward, last) if members is None else compare_ratings(everyone(forward, members), everyone(last, members))


def convergence_profile(games: DataFrame, sizes: list[int], params: dict | None = None) -> DataFrame:
    """(games, seconds): how long skill through time takes to converge on the first games of the order, for each size."""
    ship(games.sparkSession)
    n = numbered(games, F.col("ts").asc_nulls_last(), F.col("game_id").asc()).withColumn("size", F.explode(F.array(*[F.lit(int(x)) for x in sizes]))).where("pos <= size")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = make("ttt", params)
        for x in as_games(pdf):
            m.update(x)
        began = time.perf_counter()
        m.converge(force=True)
        return pd.DataFrame([(int(pdf["size"].iloc[0]), len(pdf), time.perf_counter() - began)], columns=["size", "games", "seconds"])

    return n.groupBy("size").applyInPandas(run, "size int, games long, seconds double")
