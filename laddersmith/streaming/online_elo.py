"""Elo over a stream of games: one state for each league, games applied in event-time order.

Games wait until the watermark passes them, so that late ones within the delay still come in order; later ones are
dropped by the engine. A game touches many players, so the state is keyed by league, not by player.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from laddersmith.operators.folds import as_games
from laddersmith.operators.sequential import Elo
from laddersmith.session import ship

OUTPUT = "league string, game_id long, p double"
STATE = "ratings binary, waiting binary"


def online_elo(games: DataFrame, delay: str = "0 seconds", **params: float) -> DataFrame:
    """``games``: a stream (league, ts, game_id, day, r1, r2, s1, s2, outcome_only, tournament) to predictions before each game."""
    ship(games.sparkSession)

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ratings, waiting = {}, []
        if state.exists:
            a, b = state.get
            ratings, waiting = pickle.loads(a), pickle.loads(b)
        if not state.hasTimedOut:
            for f in frames:
                waiting.append(f)
        mark = state.getCurrentWatermarkMs()
        out = []
        if waiting:
            rows = pd.concat(waiting)
            ready = rows["day"] * 86_400_000.0 < mark
            m = Elo(**params, ratings=ratings)
            for g in as_games(rows[ready]):
                out.append((str(key[0]), g.game_id, m.predict(g)))
                m.update(g)
            left = rows[~ready]
            waiting, ratings = ([left] if len(left) else []), m.ratings
            if len(left):
                state.setTimeoutTimestamp(int(max(left["day"].min() * 86_400_000.0, mark)) + 1)
        state.update((pickle.dumps(ratings), pickle.dumps(waiting)))
        yield pd.DataFrame(out, columns=["league", "game_id", "p"])

    keyed = games.withWatermark("ts", delay)
    return keyed.groupBy("league").applyInPandasWithState(run, OUTPUT, STATE, "append", "EventTimeTimeout")
