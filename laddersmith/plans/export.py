"""The statistics document: one JSON line for each of its parts, and the whole for a league of people's size."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laddersmith.functions.scores import export_flag, strict_int
from laddersmith.operators import intervals, stats
from laddersmith.operators.mates import everyone
from laddersmith.plans.history import seeds, team_histories
from laddersmith.session import materialize


def export_games(games: DataFrame) -> DataFrame:
    """Games with a readable time: stripped team names, integer scores or null, flags that are exactly 1."""
    kinds = {f.name: f.dataType.simpleString() for f in games.schema}
    mark = lambda c: F.col(c) if kinds[c] == "boolean" else export_flag(F.col(c))
    score = lambda n: F.col(f"s{n}") if f"s{n}" in kinds else strict_int(F.col(f"score{n}").cast("string"))
    out = games.where("ts is not null")
    return out.select("game_id", "ts", F.trim("team1").alias("team1"), score(1).alias("score1"), F.trim("team2").alias("team2"), score(2).alias("score2"), mark("outcome_only").alias("outcome_only"), mark("tournament").alias("tournament"))


def with_scores(games: DataFrame) -> DataFrame:
    return games.where("score1 is not null and score2 is not null")


def player_rows(history: DataFrame, games: DataFrame, rosters: DataFrame, members: DataFrame) -> DataFrame:
    """Every player of a roster or of the history: teams, record over the games with scores, current, peak and lowest rating."""
    out = members.select("player").join(stats.player_teams(rosters), "player", "left").join(stats.player_records(games, rosters), "player", "left").join(everyone(stats.rating_summary(history), members), "player", "left")
    return out.withColumn("teams", F.coalesce("teams", F.array().cast("array<string>"))).na.fill(0, ["games", "wins", "losses", "draws"])


def team_rows(games: DataFrame, rosters: DataFrame, history: DataFrame, members: DataFrame, default: float = 1000.0) -> DataFrame:
    """Every team of the rosters: members, record over the games with scores, current rating (its members' mean)."""
    own = rosters.groupBy("team").agg(F.array_sort(F.collect_set("player")).alias("members"))
    now = history.groupBy("player").agg(F.max_by("rating", F.struct(F.col("ts").isNull(), "ts", "game_id")).alias("r"))
    mean = rosters.select("team", "player").distinct().join(everyone(now, members), "player").groupBy("team").agg(F.avg("r").alias("current"))
    out = own.join(stats.team_records(games), "team", "left").join(mean, "team", "left")
    return out.withColumn("current", F.coalesce("current", F.lit(default))).na.fill(0, ["games", "wins", "losses", "draws"])


def parts(history: DataFrame, games: DataFrame, rosters: DataFrame, model: str, default: float = 1000.0, members: DataFrame | None = None) -> DataFrame:
    """(kind, key, json): a line for the metadata, each player (with the rating history), each team (with its history) and each game.

    ``history``: (ts, game_id, player, rating), changes only; every player of the rosters starts with ``default`` before the first game. The histories have a value
    for each of the document's timestamps. No part grows with the league but by what the document says of one entity.
    ``members``: whom the history's players stand for (mates.py); a history is filled and written out once, and its text is what each of them gets.
    """
    g = materialize(export_games(games), "export-games")
    scored = with_scores(g)
    if members is None:
        members = rosters.select("player").unionByName(history.select("player")).distinct().select(F.col("player").alias("stand"), "player")
    members = materialize(members, "export-members")
    text = lambda df: F.to_json(F.struct(*df.columns))
    row = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), text(df).alias("json"))
    own = rosters.select("team", "player").where("player is not null").distinct().join(members, "player").groupBy("team", F.col("stand").alias("player")).agg(F.count(F.lit(1)).alias("n"))
    start = seeds(g, own, default).select("ts", F.lit(None).cast("long").alias("game_id"), "player", "rating")
    history = materialize(history.select("ts", F.col("game_id").cast("long").alias("game_id"), "player", "rating").unionByName(start), "export-history")
    marks = intervals.changes(history, "player")
    blocks, slots = intervals.filled(marks, "player")
    blocks = materialize(blocks, "export-blocks")
    stamps = blocks.where("block = 0").agg(F.array_sort(F.collect_list(F.struct("at", intervals.time_of().alias("ts")))).alias("t")).select(F.transform("t", lambda x: x["ts"]).alias("timestamps"))
    points = lambda pair, key: intervals.lists(*pair, key).withColumnRenamed("ratings", "history")
    told = points((blocks, slots), "player").select("player", F.to_json("history").alias("_history"))
    people = player_rows(history, scored, rosters, members)
    # joined by whom they stand for, so that a text is shuffled once and not once a player
    players = people.select(F.lit("player").alias("kind"), "player", text(people).alias("json")).join(members, "player").join(told.withColumnRenamed("player", "stand"), "stand", "left")
    filled = F.concat(F.expr("left(json, length(json) - 1)"), F.lit(',"history":'), "_history", F.lit("}"))
    players = players.select("kind", F.col("player").cast("string").alias("key"), F.coalesce(filled, "json").alias("json"))
    teams = team_rows(scored, rosters, history, members, default).join(points(team_histories(history, rosters.select("team").distinct(), default, own), "team"), "team", "left")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    meta = n(members, "num_players").crossJoin(n(rosters.groupBy("team").agg(F.lit(1)), "num_teams")).crossJoin(n(scored, "num_games")).crossJoin(g.agg(F.max("ts").alias("last_update"))).crossJoin(stamps)
    meta = meta.withColumn("model", F.lit(model)).withColumn("initial_rating", F.lit(default))
    return row(meta, "metadata", "model").unionByName(players).unionByName(row(teams, "team", "team")).unionByName(row(g, "game", "game_id"))


def document(lines: DataFrame) -> dict:
    """The whole document on the driver, of parts() of a league that fits there: metadata, players, teams, games, games_with_scores."""
    out: dict = {"metadata": {}, "players": {}, "teams": {}, "games": [], "games_with_scores": []}
    for r in lines.toLocalIterator():
        x = json.loads(r.json)
        if r.kind == "metadata":
            out["metadata"] = x
        elif r.kind == "game":
            out["games"].append(x)
            if "score1" in x and "score2" in x:
                out["games_with_scores"].append(x)
        else:
            out[r.kind + "s"][r.key] = x
    for k in ("games", "games_with_scores"):
        out[k].sort(key=lambda x: (x["ts"], x["game_id"]))
    return out
