"""Players who are in the same rosters throughout: one of them stands for all.

They play the same games on the same sides, so every model gives them the same state at all times. Games then carry the stand-ins of a roster
with their numbers, which grow with the different memberships, not with the players; what a model says of a stand-in holds for all its mates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laddersmith.session import materialize


def mates(rosters: DataFrame) -> DataFrame:
    """(stand, player): for every player the least one with the same teams; compared by the teams themselves."""
    own = rosters.select("team", "player").where("team is not null and player is not null").groupBy("player").agg(F.array_sort(F.collect_set("team")).alias("teams"))
    own = materialize(own, "mates")
    return own.join(own.groupBy("teams").agg(F.min("player").alias("stand")), "teams").select("stand", "player")


def with_mates(games: DataFrame, rosters: DataFrame, members: DataFrame) -> DataFrame:
    """Games with the stand-ins of both sides' players, r1 and r2, and how many players each is, n1 and n2; a team without a roster has none."""
    size = members.groupBy("stand").agg(F.count(F.lit(1)).cast("int").alias("n"))
    r = rosters.select("team", F.col("player").alias("stand")).distinct().join(size, "stand")
    r = r.groupBy("team").agg(F.array_sort(F.collect_list(F.struct("stand", "n"))).alias("x")).where("team is not null")
    for k in (1, 2):
        side = r.select(F.col("team").alias(f"team{k}"), F.transform("x", lambda y: y["stand"]).alias(f"r{k}"), F.transform("x", lambda y: y["n"]).alias(f"n{k}"))
        games = games.join(side, f"team{k}", "left")
    kinds = {f.name: f.dataType for f in games.schema}
    return games.select(*[F.coalesce(c, F.array().cast(kinds[c])).alias(c) if c in ("r1", "r2", "n1", "n2") else c for c in games.columns])


def everyone(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of stand-ins (player, ...) as rows of all players that they stand for."""
    return rows.withColumnRenamed("player", "stand").join(members, "stand").select(*rows.columns)


def stands(rosters: DataFrame, members: DataFrame) -> DataFrame:
    """(team, player) of the rosters for those who stand for others alone."""
    return rosters.select("team", "player").distinct().join(members.select(F.col("stand").alias("player")).distinct(), "player", "left_semi").select("team", "player")
