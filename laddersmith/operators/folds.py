"""Ordered folds of games through rating models.

catalyst_elo() is an aggregate over a sorted array and needs no Python; fold() streams the games of each league (games that share no
player, directly or through others), trial and segment in order through a model, a batch at a time: no task holds a league's rows.
Order is (ts nulls last, game_id).
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat

import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laddersmith.functions.scores import flag, strict_int
from laddersmith.operators.graph import side_leagues
from laddersmith.operators.sequential import Game
from laddersmith.session import materialize, parallelism, ship

#: What a model reads of a game.
COLUMNS = ["game_id", "ts", "day", "team1", "team2", "r1", "r2", "s1", "s2", "outcome_only", "tournament", "on_court"]
#: What it reads as well, if games have it (mates.py).
COUNTS = ["n1", "n2"]
#: Copies of the games' stream, at most, between which the trials of a search are dealt.
LANES = 2
#: Rows that are gathered before they leave a task.
OUT = 20_000


def _game(r: dict) -> Game:
    day, s1, s2, court = r["day"], r["s1"], r["s2"], r.get("on_court")
    known = [x is not None and x == x for x in (s1, s2)]
    return Game(
        r["game_id"], None if day is None or day != day else float(day), list(r["r1"]), list(r["r2"]), int(s1) if known[0] else 0, int(s2) if known[1] else 0, readable=all(known),
        outcome_only=bool(r.get("outcome_only")), tournament=bool(r.get("tournament")), on_court=8 if court is None or court != court else int(court), teams=(r["team1"], r["team2"]) if "team1" in r else None,
        n1=r.get("n1"), n2=r.get("n2"), times=r.get("times") or 1,
    )


def as_games(pdf: pd.DataFrame) -> list[Game]:
    """Rows (game_id, day, r1, r2, s1, s2, ...) as games in order."""
    return [_game(r) for r in pdf.sort_values(["day", "game_id"], na_position="last").to_dict("records")]


def prepare(games: DataFrame, on_court: int = 8) -> DataFrame:
    """Games with rosters (with_rosters()) to what the models read; both the readers' typed games and raw text columns will do.

    Scores that are no integers are null; each model has its own rule for them. ``on_court``: players on court where the game doesn't say.
    """
    kinds = {f.name: f.dataType.simpleString() for f in games.schema}
    score = lambda n: F.col(f"s{n}").cast("int") if f"s{n}" in kinds else strict_int(F.col(f"score{n}").cast("string"))
    mark = lambda c: F.coalesce(F.col(c), F.lit(False)) if kinds[c] == "boolean" else flag(F.col(c))
    court = F.coalesce(F.col("players_on_court"), F.lit(on_court)) if "players_on_court" in kinds else F.lit(on_court)
    return games.select(
        "game_id", "ts", (F.unix_timestamp("ts") / 86400.0).alias("day"), "team1", "team2", "r1", "r2", score(1).alias("score1"), score(2).alias("score2"),
        score(1).alias("s1"), score(2).alias("s2"), mark("outcome_only").alias("outcome_only"), mark("tournament").alias("tournament"), court.cast("int").alias("on_court"),
        *[c for c in COUNTS if c in kinds],
    )


def player_type(games: DataFrame) -> str:
    return games.schema["r1"].dataType.elementType.simpleString()


def catalyst_elo(games: DataFrame, initial: float = 1000.0, k: float = 346.446, tournament_factor: float = 1.514) -> DataFrame:
    """(game_id, p): Elo's probability before each game, as one aggregate over the games in order.

    For leagues of up to some thousand games: the state is copied at each step. ``games`` as of prepare().
    """
    players = games.select(F.explode(F.array_distinct(F.concat("r1", "r2"))).alias("player")).distinct()
    ids = players.agg(F.array_sort(F.collect_list("player")).alias("ids"))
    rows = games.crossJoin(F.broadcast(ids)).select(
        F.struct(
            F.col("ts").isNull().alias("late"), "ts", "game_id",
            F.transform("r1", lambda p: F.array_position("ids", p).cast("int")).alias("i1"), F.transform("r2", lambda p: F.array_position("ids", p).cast("int")).alias("i2"),
            "s1", "s2", F.when(F.col("tournament"), tournament_factor).otherwise(1.0).alias("mult"),
        ).alias("g"), F.size("ids").alias("n"),
    )
    one = rows.groupBy("n").agg(F.array_sort(F.collect_list("g")).alias("gs"))
    mean = lambda st, i: f"aggregate({i}, 0D, (a, x) -> a + element_at({st}, x)) / size({i})"
    step = f"""aggregate(gs, named_struct('r', array_repeat({initial}D, n), 'out', CAST(array() AS array<struct<game_id:bigint,p:double>>)),
      (s, g) -> element_at(transform(array(named_struct(
          'a', CASE WHEN size(g.i1) = 0 THEN {initial}D ELSE {mean('s.r', 'g.i1')} END, 'b', CASE WHEN size(g.i2) = 0 THEN {initial}D ELSE {mean('s.r', 'g.i2')} END)),
        m -> element_at(transform(array(named_struct('p', 1D / (1D + power(10D, (m.b - m.a) / 400D)))),
          e -> element_at(transform(array({k}D * (CASE WHEN abs(g.s1 - g.s2) <= 1 THEN 1D WHEN abs(g.s1 - g.s2) = 2 THEN 1.5D ELSE (11 + abs(g.s1 - g.s2)) / 8D END) * g.mult
              * ((CASE WHEN g.s1 > g.s2 THEN 1D WHEN g.s1 < g.s2 THEN 0D ELSE 0.5D END) - (CASE WHEN size(g.i1) = 0 OR size(g.i2) = 0 THEN 0.5D ELSE e.p END))),
            c -> named_struct('r', transform(s.r, (x, j) -> x + (CASE WHEN array_contains(g.i1, j + 1) THEN c / size(g.i1) ELSE 0D END) - (CASE WHEN array_contains(g.i2, j + 1) THEN c / size(g.i2) ELSE 0D END)),
                             'out', concat(s.out, array(named_struct('game_id', g.game_id, 'p', e.p))))), 1)), 1)), 1), s -> s.out)"""
    return one.select(F.explode(F.expr(step)).alias("x")).select("x.game_id", "x.p")


def one_trial(games: DataFrame) -> DataFrame:
    return games.sparkSession.range(1).select(F.lit(0).cast("long").alias("trial_id"), F.create_map().cast("map<string,string>").alias("params"))


def compact(games: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Games with keys of their sides, h1 and h2 (null: nobody), and the sides (side, team, r, n): what is shuffled of a game doesn't grow with its rosters."""
    kinds, counted = dict(games.dtypes), set(COUNTS) <= set(games.columns)
    side = lambda k: [f"team{k}", f"r{k}", *([f"n{k}"] if counted else [])]
    key = lambda k: F.when(F.size(f"r{k}") > 0, F.xxhash64(*side(k)))
    marks = (F.coalesce("outcome_only", F.lit(False)).cast("int") + 2 * F.coalesce("tournament", F.lit(False)).cast("int")).alias("marks")
    flat = materialize(games.select("game_id", F.unix_micros("ts").alias("us"), "day", key(1).alias("h1"), key(2).alias("h2"), "s1", "s2", marks, "on_court"), "games")
    n = lambda k: (F.col(f"n{k}") if counted else F.lit(None).cast("array<int>")).alias("n")
    both = F.explode(F.array(*[F.struct(key(k).alias("side"), F.col(f"team{k}").cast("string").alias("team"), F.col(f"r{k}").cast(kinds["r1"]).alias("r"), n(k)) for k in (1, 2)]))
    return flat, materialize(games.select(both.alias("x")).select("x.*").where("side is not null").distinct(), "sides")


#: Where the sides of a stream stand: before all its games.
_FIRST = -(2**63)


def events(games: DataFrame, flat: DataFrame, sides: DataFrame, asks: DataFrame | None, shared: bool) -> tuple[DataFrame, DataFrame]:
    """One row for each thing that a model does, with its league: learn from a game (and predict it first, if there are no ``asks``), or
    predict a game as of a time ``cp`` (``asks``: cp in microseconds and a game_id; ``settled``, if they have it, is the time up to which the model converges before). And the sides with their leagues."""
    none = F.lit(None).cast("long")
    rows = flat.select("*", F.lit(1).alias("phase"), F.lit(asks is None).alias("ask"))
    if asks is not None:
        told = asks.select("game_id", "cp", F.col("settled") if "settled" in asks.columns else none.alias("settled"))
        told = told.join(flat, "game_id").select(*[F.col("cp").alias("us") if c == "us" else c for c in flat.columns], F.lit(0).alias("phase"), F.lit(True).alias("ask"), "cp", "settled")
        rows = rows.select("*", none.alias("cp"), none.alias("settled")).unionByName(told)
    if shared:
        return rows.withColumn("league", F.lit("")), sides.withColumn("league", F.lit(""))
    leagues = materialize(side_leagues(sides, flat.select("h1", "h2")).withColumn("league", F.col("league").cast("string")), "side-leagues")
    for k in (1, 2):
        rows = rows.join(leagues.select(F.col("side").alias(f"h{k}"), F.col("league").alias(f"league{k}")), f"h{k}", "left")
    own = F.concat(F.lit("g"), F.col("game_id").cast("string"))
    return rows.withColumn("league", F.coalesce("league1", "league2", own)).drop("league1", "league2"), sides.join(leagues, "side")


def _dealt(games: DataFrame, asks: DataFrame | None, shared: bool, segments: int, dated: bool, lanes: int, decay: float | None = None) -> DataFrame:
    """The streams of fold(), dealt to tasks and sorted."""
    dated = dated and decay is None
    flat, sides = compact(games)
    g, sides = events(games, flat, sides, asks, shared)
    late = F.col("us").isNull()
    n_segments = 1
    if segments > 1:
        bounds = sorted(set(flat.approxQuantile("us", [i / segments for i in range(1, segments)], 0.001)))
        n_segments = len(bounds) + 1
        own = F.lit(0)
        for b in bounds:
            own = own + F.when(late | (F.col("us") >= int(b)), 1).otherwise(0)
        g = g.withColumn("segment", own).withColumn("mine", F.lit(True)).withColumn("times", F.lit(1).cast("long" if decay is None else "double"))
        past = g.where(F.col("phase") == 1).where(F.col("segment") < len(bounds))
        apart = {"game_id", "us", "mine", "times", "ask", "phase", "cp", "settled"} | (set() if dated else {"day"})
        equal = [c for c in g.columns if c not in apart]
        # equal games of one stretch first, then of all stretches before each: what reaches it grows with different games, not with stretches of them
        alike = [c for c in equal if c != "segment"]
        # plain numbers, so that a task's equal games are added up before they are shuffled; a row stands where the first of its games does
        first = [F.min("us").alias("us"), F.min("game_id").alias("game_id")]
        f = F.struct("us", "game_id").alias("f")
        if decay is None:
            past = past.groupBy(*equal).agg(*first, F.count(F.lit(1)).alias("times"))
            past = past.groupBy(*alike).agg(F.collect_list(F.struct("segment", f, "times")).alias("own"))
            day, times = F.col("day") if dated else F.lit(None).cast("double"), "aggregate(own.times, 0L, (n, x) -> n + x)"
        else:
            # as of the end of their stretch, then of the newest of them: only games that fade against those near the end are lost to floats
            ends = F.element_at(F.array(*[F.lit(b / 86400e6) for b in bounds]), F.col("segment") + 1)
            past = past.withColumn("faded", F.pow(F.lit(decay), (ends - F.col("day")) / 7))
            past = past.groupBy(*equal).agg(*first, F.max("day").alias("newest"), F.sum("faded").alias("times"))
            past = past.groupBy(*alike).agg(F.collect_list(F.struct("segment", f, ends.alias("end"), "newest", "times")).alias("own"))
            day, times = F.expr("array_max(own.newest)"), f"aggregate(own, 0D, (n, x) -> n + x.times * power({decay!r}D, (array_max(own.newest) - x.end) / 7))"
        past = past.withColumn("segment", F.explode(F.expr(f"sequence(array_min(own.segment) + 1, {len(bounds)})")))
        past = past.withColumn("own", F.expr("filter(own, x -> x.segment < segment)"))
        past = past.withColumn("f", F.expr("array_min(own.f)")).withColumn("day", day).withColumn("times", F.expr(times)).drop("own")
        rest = {"phase": F.lit(1), "mine": F.lit(False), "ask": F.lit(False), "us": F.col("f.us"), "game_id": F.col("f.game_id"), "day": F.col("day")}
        g = g.unionByName(past.select(*[(rest[c] if c in rest else F.lit(None).cast("long") if c in ("cp", "settled") else F.col(c)).alias(c) for c in g.columns]))
    else:
        g = g.withColumn("segment", F.lit(0)).withColumn("mine", F.lit(True))
    g = g.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))) if lanes > 1 else g.withColumn("lane", F.lit(0)).where(F.lit(lanes > 0))
    g = g.withColumn("marks", F.col("marks") + 4 * F.col("ask").cast("int") + 8 * F.col("mine").cast("int")).drop("ask", "mine")
    told = sides.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(max(lanes, 1) - 1)))).withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(n_segments - 1))))
    told = told.withColumn("us", F.lit(_FIRST)).withColumn("phase", F.lit(-1)).withColumnRenamed("side", "h1").withColumn("game_id", F.lit(0).cast("long"))
    g = g.unionByName(told, allowMissingColumns=True)
    n = max(parallelism(games.sparkSession), segments)
    # lanes and segments of one league go to different tasks
    task = F.pmod(F.xxhash64("league") + F.col("lane") + F.col("segment"), F.lit(n)).cast("int")
    order = ["league", "lane", "segment", late, "us", "phase", "game_id"]
    return g.repartitionById(n, task).sortWithinPartitions(*order)


def unkeep(kept: dict) -> None:
    """Free what fold() has kept there."""
    for df in kept.values():
        df.unpersist()
    kept.clear()


def fold(games: DataFrame, make: Callable[[dict], object], trials: DataFrame | None = None, ratings: bool = False, asks: DataFrame | None = None, shared: bool = False, segments: int = 1, after: int | None = None, dated: bool = True, kept: dict | None = None, decay: float | None = None) -> DataFrame:
    """Predictions (trial_id, cp, game_id, p, y): of each game before it is learned, or of the ``asks``; y is 1 if side 1 won, 0 if side 2 did, else null.

    With ``ratings`` the states instead (trial_id, ts, game_id, player, rating, mu, sigma): of games at one time the last counts; a sequential
    model tells the players that played (changes only), a batch model all that it knows, after ``after`` (microseconds) if that is given.
    ``trials``: (trial_id, params map<string,string> of JSON values), hundreds at most as a search makes them; dealt to LANES copies of the games' stream, and a
    task passes each game to all of its trials, so that what is shuffled doesn't grow with them.
    ``shared``: the model has parameters common to all leagues. ``segments``: stretches of time that are worked on at once by a model whose state after a
    game doesn't depend on what it was asked before (batch fits): each learns from all games before its end, and answers for its own. Equal games before a stretch reach it as one row with their
    number (``dated``: only those of one time are equal; with ``decay``, by which games of all trials fade each week, the row is as many as they are worth at its newest), in the order of the first.
    ``kept``: where calls with the same games, asks, segments and model leave the dealt and sorted stream for the next one (on the executors' disks); see unkeep().
    """
    ship(games.sparkSession)
    specs = [(0, {})] if trials is None else [(r.trial_id, {k: json.loads(v) for k, v in (r.params or {}).items()}) for r in trials.select("trial_id", "params").orderBy("trial_id").toLocalIterator()]
    if kept is None:
        lanes = min(LANES, len(specs))
        g = _dealt(games, asks, shared, segments, dated, lanes, decay)
    else:
        # the same stream is read by as many tasks as there are cores for the trials
        lanes = min(games.sparkSession.sparkContext.defaultParallelism, len(specs))
        if "stream" not in kept:
            kept["stream"] = _dealt(games, asks, shared, segments, dated, 1, decay).persist(StorageLevel.DISK_ONLY)
        one = kept["stream"]
        g = reduce(DataFrame.union, [one.withColumn("lane", F.lit(k)) for k in range(lanes)]) if lanes else one.limit(0)
    player = player_type(games)
    schema = f"trial_id long, us long, game_id long, player {player}, rating double, mu double, sigma double" if ratings else "trial_id long, cp long, game_id long, p double, y double"
    kinds = {"long": pa.int64(), "double": pa.float64(), "bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}
    fields = [(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ms, us, told, touched = None, [], None, True, {}
        out: list[list] = [[] for _ in fields]

        def batch() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(out, fields, strict=True)], names=[f for f, _ in fields])
            for x in out:
                x.clear()
            return b

        def tell() -> None:
            """The state after the games of one time."""
            nonlocal told
            if told or after is not None and us is not None and us <= after:
                return
            told = True
            for trial, m in ms:
                if hasattr(m, "converge_all"):
                    m.converge_all()
                    names, mu, shown = m.table()
                    rows = (shown, mu, [None] * len(names), [last] * len(names))
                else:
                    names = list(touched)
                    got = [m._get(p) if hasattr(m, "_get") else (m.expose(p), None) for p in names]
                    rows = ([m.expose(p) for p in names], [x[0] for x in got], [x[1] for x in got], list(touched.values()))
                shown, mu, sigma, ids = rows
                for x, y in zip(out, ([trial] * len(names), [us] * len(names), ids, names, shown, mu, sigma), strict=True):
                    x.extend(y)
            touched.clear()

        if not ratings:
            told_trial, told_cp, told_game, told_p, told_y = out
        last, past = None, []
        for at, phase, marks, us_, cp, settled, x in _read(batches):
            if at != key:
                if ratings:
                    tell()
                touched.clear()
                past.clear()
                key, us, told = at, None, True
                ms = [(t, make(dict(p))) for t, p in specs[at[1] :: lanes]]
            if phase < 0:
                continue
            if ratings and us_ != us:
                tell()
                touched.clear()
                told = True
            us = us_
            if marks & 12 == 12 and not ratings:
                y = (1.0 if x.s1 > x.s2 else 0.0 if x.s1 < x.s2 else None) if x.readable else None
                for trial, m in ms:
                    if settled is not None:
                        m.settle(bisect_left(past, settled))
                    told_trial.append(trial)
                    told_cp.append(cp)
                    told_game.append(x.game_id)
                    told_p.append(m.predict(x))
                    told_y.append(y)
            if phase:
                for _, m in ms:
                    m.update(x)
                last = x.game_id
                if hasattr(m, "settle") and us is not None:
                    past.append(us)
                if ratings and marks & 8 and (x.r1 and x.r2 or not hasattr(m, "last_day")):  # such a game changes nothing, not even when its players last played
                    told = False
                    touched.update(dict.fromkeys(x.r1, x.game_id))
                    touched.update(dict.fromkeys(x.r2, x.game_id))
            if len(out[0]) >= OUT:
                yield batch()
        if ratings:
            tell()
        if out[0]:
            yield batch()

    def lanes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """run() for models that have lanes: games stay columns, states are lists."""
        key, told_at, ms, seen = None, None, [], {}
        places, sides, book = {}, [], {}
        names: list = []
        out: list[list] = [[] for _ in fields]

        def batch() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(out, fields, strict=True)], names=[f for f, _ in fields])
            for x in out:
                x.clear()
            return b

        def tell() -> None:
            """The states of those who played at one time, whose last game is their greatest: games stand in order."""
            last: dict = {}
            for k, game in seen.items():
                for p in sides[k][0]:
                    if p not in last or last[p] < game:
                        last[p] = game
            seen.clear()
            for trial, m in ms:
                out[0].extend([trial] * len(last))
                out[1].extend([told_at] * len(last))
                out[2].extend(last.values())
                out[3].extend([names[p] for p in last])
                for p in last:
                    shown, mu, sigma = m.shown(p)
                    out[4].append(shown)
                    out[5].append(mu)
                    out[6].append(sigma)

        for rows in _columns(batches):
            for at, phase, marks, us, cp, game, h1, h2, s1, s2, court, team, r, n in rows:
                if at is not key and at != key:
                    if seen:
                        tell()
                    key, book = at, {None: (0, None)}
                    places, sides, names = {}, [([], [], 0)], []
                    ms = [(t, make(dict(p)).lane(places, sides)) for t, p in specs[at[1] :: lanes]]
                if phase < 0:
                    own = (team, r, n)
                    if book.setdefault(h1, (len(sides), own))[1] != own:
                        raise ValueError(f"two sides have the key {h1}")
                    if book[h1][0] == len(sides):
                        for p in r:
                            if p not in places:
                                places[p] = len(names)
                                names.append(p)
                        n = [1] * len(r) if n is None else n
                        sides.append(([places[p] for p in r], n, sum(n)))
                        for _, m in ms:
                            m.grow()
                    continue
                a, b = book[h1][0], book[h2][0]
                readable = s1 is not None and s2 is not None
                s1, s2, court = s1 or 0, s2 or 0, 8 if court is None else court
                if ratings:
                    if us != told_at and seen:
                        tell()
                    told_at = us
                    for _, m in ms:
                        m.learn(a, b, s1, s2, readable, marks & 1 == 1, marks & 2 == 2, court, None)
                    seen[a] = seen[b] = game
                    continue
                asked = marks & 4
                y = (1.0 if s1 > s2 else 0.0 if s1 < s2 else None) if readable else None
                for trial, m in ms:
                    p = None
                    if asked:
                        p = m.predict(a, b, court)
                        out[0].append(trial)
                        out[1].append(cp)
                        out[2].append(game)
                        out[3].append(p)
                        out[4].append(y)
                    if phase:
                        m.learn(a, b, s1, s2, readable, marks & 1 == 1, marks & 2 == 2, court, p)
                if len(out[0]) >= OUT:
                    yield batch()
            if len(out[0]) >= OUT:
                yield batch()
        if seen:
            tell()
        if out[0]:
            yield batch()

    straight = segments == 1 and after is None and bool(specs) and hasattr(make(dict(specs[0][1])), "lane")
    done = g.mapInArrow(lanes_of if straight else run, schema)
    return done.select("trial_id", F.timestamp_micros("us").alias("ts"), "game_id", "player", "rating", "mu", "sigma") if ratings else done


def learned(games: DataFrame, make: Callable[[dict], object], tell: Callable[[object, set], Iterator[tuple]], schema: str) -> DataFrame:
    """What ``tell`` says of each league's model after all its games, as lists of ``schema``'s columns; it also gets the days that games have.

    The games pass through a model as a stream: of a league a task holds what the model holds."""
    ship(games.sparkSession)
    g = _dealt(games, None, False, 1, True, 1)
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"double": pa.float64(), "bigint": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, m, days = None, None, set()

        def done():
            for cols in tell(m, days):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=names)

        for at, phase, *_, x in _read(batches):
            if at != key:
                if m is not None:
                    yield from done()
                key, m, days = at, make({}), set()
            if phase > 0:
                m.update(x)
                days.add(x.day)
        if m is not None:
            yield from done()

    return g.mapInArrow(run, schema)


#: What a stream's rows have in common.
_STREAM = ("league", "lane", "segment")


def _values(c: pa.Array):
    """A column's values as Python has them."""
    if c.null_count == len(c):
        return repeat(None, len(c))
    if c.null_count or not (pa.types.is_integer(c.type) or pa.types.is_floating(c.type)):
        return c.to_pylist()
    return c.to_numpy(zero_copy_only=False).tolist()


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple]]:
    """Of each Arrow batch the rows (stream, phase, marks, us, cp, game_id, h1, h2, s1, s2, on_court, team, r, n)."""
    for b in batches:
        if not b.num_rows:
            continue
        names = b.schema.names
        ends = [[b.column(c)[i].as_py() for c in _STREAM] for i in (0, -1)]
        keys = repeat(tuple(ends[0])) if ends[0] == ends[1] else zip(*(b.column(c).to_pylist() for c in _STREAM), strict=True)
        get = lambda c: _values(b.column(c)) if c in names else repeat(None)  # noqa: B023, E731
        yield zip(keys, *map(get, ("phase", "marks", "us", "cp", "game_id", "h1", "h2", "s1", "s2", "on_court", "team", "r", "n")), strict=False)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(stream, phase, marks, us, cp, settled, game) of the rows of Arrow batches; a stream is a league, lane and segment and begins with its sides, which its games name by their keys."""
    key, book = None, {}
    for b in batches:
        names = b.schema.names
        cols = dict(zip(names, map(_values, b.columns), strict=True))
        if b.num_rows and all(b.column(c)[0].as_py() == b.column(c)[-1].as_py() for c in _STREAM):  # sorted by them, so all rows have the same
            cols |= {c: repeat(b.column(c)[0].as_py(), b.num_rows) for c in _STREAM}
        none = repeat(None)
        get = lambda c: cols[c] if c in names else none  # noqa: B023, E731
        rows = zip(*map(get, ("league", "lane", "segment", "phase", "marks", "us", "cp", "settled", "game_id", "day", "h1", "h2", "s1", "s2", "on_court", "times", "team", "r", "n")), strict=False)
        for league, lane, segment, phase, marks, us, cp, settled, game, day, h1, h2, s1, s2, court, times, team, r, n in rows:
            if key is None or lane != key[1] or segment != key[2] or league != key[0]:
                key = (league, lane, segment)
                book = {None: (None, [], None, ([], [], 0))}
            if phase < 0:
                own = (team, r, n, (r, [1] * len(r), len(r)) if n is None else (r, n, sum(n)))
                if book.setdefault(h1, own) != own:
                    raise ValueError(f"two sides have the key {h1}")
                yield key, phase, 0, us, None, None, None
                continue
            (t1, r1, n1, side1), (t2, r2, n2, side2) = book[h1], book[h2]
            known = s1 is not None and s2 is not None
            yield key, phase, marks, us, cp, settled, Game(
                game, None if day is None or day != day else day, r1, r2, s1 if s1 is not None else 0, s2 if s2 is not None else 0, known,
                marks & 1 == 1, marks & 2 == 2, 8 if court is None else court, (t1, t2), n1, n2, 1 if times is None else times, side1, side2,
            )
