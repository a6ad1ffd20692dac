"""Joins of games, rosters, aliases and rating curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laddersmith.operators.order import numbered


def roster_arrays(rosters: DataFrame) -> DataFrame:
    """(team, players): sorted distinct players of each team."""
    return rosters.groupBy("team").agg(F.array_sort(F.collect_set("player")).alias("players"))


def with_rosters(games: DataFrame, rosters: DataFrame) -> DataFrame:
    """Games with both sides' players, r1 and r2; a team without a roster has none.

    The roster side is small against games but not bounded, so Spark chooses the join by its size.
    """
    r = roster_arrays(rosters)
    empty = F.array().cast(r.schema["players"].dataType)
    a = r.select(F.col("team").alias("team1"), F.col("players").alias("r1"))
    b = r.select(F.col("team").alias("team2"), F.col("players").alias("r2"))
    out = games.join(a, "team1", "left").join(b, "team2", "left")
    return out.withColumn("r1", F.coalesce("r1", empty)).withColumn("r2", F.coalesce("r2", empty))


def with_roster_sums(games: DataFrame, rosters: DataFrame) -> DataFrame:
    """Games with the number of both sides' players, n1 and n2, and the sum of their ids, sum1 and sum2: formed by team before the join, so that no game carries a roster."""
    r = rosters.select("team", "player").where("player is not null").distinct().groupBy("team").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum("player").cast("long").alias("sum"))
    for k in (1, 2):
        games = games.join(r.select(F.col("team").alias(f"team{k}"), F.col("n").alias(f"n{k}"), F.col("sum").alias(f"sum{k}")), f"team{k}", "left")
    return games.na.fill(0, ["n1", "n2", "sum1", "sum2"])


def matched_only(games: DataFrame, rosters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Games whose teams both have rosters under trimmed lower-case names; and the names that have none."""
    known = rosters.select(F.lower(F.trim("team")).alias("_k")).distinct()
    keyed = games.withColumn("_k1", F.lower(F.trim("team1"))).withColumn("_k2", F.lower(F.trim("team2")))
    inner = keyed.join(known.withColumnRenamed("_k", "_k1"), "_k1", "left_semi").join(known.withColumnRenamed("_k", "_k2"), "_k2", "left_semi")
    names = keyed.select(F.explode(F.array("_k1", "_k2")).alias("_k")).distinct()
    return inner.drop("_k1", "_k2"), names.join(known, "_k", "left_anti").select(F.col("_k").alias("team"))


def perspectives(games: DataFrame) -> DataFrame:
    """Each game under both of its teams: team, own and other score, side."""
    side = F.explode(F.array(
        F.struct(F.col("team1").alias("team"), F.col("score1").alias("own"), F.col("score2").alias("other"), F.lit(1).alias("side")),
        F.struct(F.col("team2").alias("team"), F.col("score2").alias("own"), F.col("score1").alias("other"), F.lit(2).alias("side")),
    ))
    return games.select("game_id", "ts", side.alias("x")).select("game_id", "ts", "x.*")


def known_teams_only(games: DataFrame, rosters: DataFrame) -> DataFrame:
    """Drops games that name a team without roster."""
    t = rosters.select("team").distinct()
    return games.join(t.withColumnRenamed("team", "team1"), "team1", "left_semi").join(t.withColumnRenamed("team", "team2"), "team2", "left_semi")


def new_games(additions: DataFrame, existing: DataFrame, within: bool = False) -> DataFrame:
    """Additions whose (time, teams in either order) ``existing`` doesn't have; with ``within`` one of each among themselves."""
    key = [F.col("ts"), F.least("team1", "team2").alias("_lo"), F.greatest("team1", "team2").alias("_hi")]
    old = existing.select(*key).distinct()
    new = additions.withColumn("_lo", F.least("team1", "team2")).withColumn("_hi", F.greatest("team1", "team2"))
    new = new.join(old, ["ts", "_lo", "_hi"], "left_anti")
    if within:
        w = Window.partitionBy("ts", "_lo", "_hi").orderBy("game_id")
        new = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return new.drop("_lo", "_hi")


def asof(left: DataFrame, right: DataFrame, key: str, at: str, value: str, default=None) -> DataFrame:
    """``left`` (key, at, ...) with the last ``value`` of ``right`` (key, at, value) at or before it.

    A union and a window by key: one shuffle, no range join. Ties go to the right side.
    """
    cols = left.columns
    kinds = {f.name: f.dataType for f in left.schema}
    marks = right.select(F.col(key), F.col(at), *[F.lit(None).cast(kinds[c]).alias(c) for c in cols if c not in (key, at)], F.col(value).alias("_v"), F.lit(0).alias("_s"))
    asks = left.select(key, at, *[c for c in cols if c not in (key, at)], F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_s"))
    w = Window.partitionBy(key).orderBy(at, "_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = marks.unionByName(asks).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_s = 1")
    return both.select(*cols, (F.coalesce("_v", F.lit(default)) if default is not None else F.col("_v")).alias(value))


def apply_aliases(rosters: DataFrame, aliases: DataFrame, key) -> DataFrame:
    """Rosters with preferred names; the first slot of a repeated name stays."""
    last = aliases.groupBy("alias").agg(F.max_by("preferred", "ordinal").alias("preferred"))
    out = rosters.withColumn("_a", key(F.col("player"))).join(last.withColumnRenamed("alias", "_a"), "_a", "left")
    return ordered_distinct(out.select("team", "slot", F.coalesce("preferred", "player").alias("player")))


def ordered_distinct(rosters: DataFrame) -> DataFrame:
    """One row for each (team, player): the least slot."""
    return rosters.groupBy("team", "player").agg(F.min("slot").alias("slot")).select("team", "slot", "player")


def with_season_suffix(rows: DataFrame, seasons: DataFrame, name: str) -> DataFrame:
    """``name`` with its file's season; the last mapping of a file counts."""
    last = seasons.groupBy("filename").agg(F.max_by("suffix", "ordinal").alias("_suffix"))
    return rows.join(last, "filename", "left").withColumn(name, F.concat_ws(" ", F.col(name), F.col("_suffix"))).drop("_suffix")


#: Fixed value: a season at the end of a team's name.
SEASON = r"\s\([A-Za-z]{1,2}\d{2}\)$"


def upsert_teams(old: DataFrame, new: DataFrame, managed: DataFrame | None = None) -> DataFrame:
    """Rosters where the teams of ``new`` replace those of ``old``.

    A new team with a season in its name that isn't there yet replaces the one of the same name without season, if ``managed`` (team) has that.
    """
    names = new.select("team").distinct()
    if managed is not None:
        plain = names.join(old.select("team").distinct(), "team", "left_anti").where(F.col("team").rlike(SEASON)).select(F.regexp_replace("team", SEASON, "").alias("team"))
        names = names.unionByName(plain.join(managed.select("team").distinct(), "team", "left_semi")).distinct()
    return old.join(names, "team", "left_anti").unionByName(new)


def replace_cells(rosters: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names replaced by stripped value; the white space around them stays."""
    last = aliases.groupBy("alias").agg(F.max_by("preferred", "ordinal").alias("_to"))
    out = rosters.withColumn("_k", F.trim("player")).join(last.withColumnRenamed("alias", "_k"), "_k", "left")
    pad = lambda p: F.regexp_extract("player", p, 1)
    return out.withColumn("player", F.when(F.col("_to").isNull(), F.col("player")).otherwise(F.concat(pad(r"^(\s*)"), "_to", pad(r"(\s*)$")))).drop("_k", "_to")


def training_prefix(checkpoints: DataFrame, games: DataFrame, *sums: Column) -> DataFrame:
    """(cp, train_games, ...): for each checkpoint (cp, cp_ts) how many games are strictly before it, and the ``sums`` over them, by their names.

    Games and checkpoints are merged in one order, dealt by ranges of time; the running sums at a checkpoint are those of its prefix. No join of ranges."""
    marks = checkpoints.select(F.unix_micros("cp_ts").alias("_us"), F.lit(0).alias("_kind"), "cp")
    rows = games.where("ts is not null").select(F.unix_micros("ts").alias("_us"), F.lit(1).alias("_kind"), F.lit(None).cast(checkpoints.schema["cp"].dataType).alias("cp"), F.lit(1).alias("train_games"), *sums)
    names = [c for c in rows.columns if c not in ("_us", "_kind", "cp")]
    both = rows.unionByName(marks, allowMissingColumns=True).na.fill(0, names)
    # games at one time as one row, so that no time is too large for a range
    both = both.groupBy("_us", "_kind", "cp").agg(*[F.sum(c).alias(c) for c in names])
    return numbered(both, F.col("_us"), F.col("_kind"), weights={c: F.col(c) for c in names}).where("_kind = 0").select("cp", *names)
