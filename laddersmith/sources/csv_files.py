"""Readers of delimited text: games, rosters, aliases, seasons, rating histories, configurations."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laddersmith.functions import scores
from laddersmith.functions.names import lookup_key
from laddersmith.functions.times import parse_any_time, parse_time
from laddersmith.schema import RAW_GAMES

_CELLS = [c.split()[0] for c in RAW_GAMES.split(", ")]


def _cells(line, schema: str):
    return F.from_csv(line, schema, {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})


def read_games(spark: SparkSession, path: str, min_columns: int = 5) -> DataFrame:
    """Typed games; rows of fewer cells are dropped, missing cells are empty.

    game_id grows with a line's place in the file.
    """
    width = len(_CELLS)
    schema = ", ".join(f"c{i} string" for i in range(width))
    lines = spark.read.option("header", False).text(path).select(F.monotonically_increasing_id().alias("game_id"), "value")
    cells = F.size(F.split(F.regexp_replace("value", r'"[^"]*"', "x"), ",", -1)).alias("cells")
    raw = lines.where("trim(value) <> ''").select("game_id", _cells(F.col("value"), schema).alias("c"), cells)
    raw = raw.where(f"cells >= {min_columns}").select("game_id", *[F.coalesce(F.col(f"c.c{i}"), F.lit("")).alias(n) for i, n in enumerate(_CELLS)])
    return typed_games(raw.where(~F.lower(F.trim("time")).startswith("time")))


def typed_games(raw: DataFrame) -> DataFrame:
    """The canonical games of raw text columns (and game_id)."""
    return raw.select(
        "game_id", parse_time(F.col("time")).alias("ts"), F.col("time").alias("time_raw"), "team1", F.col("score1").alias("score1_raw"), "team2", F.col("score2").alias("score2_raw"),
        scores.strict_int(F.col("score1")).alias("s1"), scores.strict_int(F.col("score2")).alias("s2"), scores.flag(F.col("outcome_flag")).alias("outcome_only"), scores.flag(F.col("tourney_flag")).alias("tournament"),
        scores.strict_int(F.col("players_field")).alias("players_on_court"), F.col("outcome_flag").alias("outcome_raw"), F.col("tourney_flag").alias("tournament_raw"),
    )


def float_of(c: str):
    """A score that may be any number, for diagnostics."""
    return scores.float_score(F.col(c))


def read_wide_rosters(spark: SparkSession, path: str, strip: bool = False) -> DataFrame:
    """(team, slot, player) of a file with one column for each team; blank cells are no players."""
    wide = spark.read.option("header", True).option("multiLine", True).option("inferSchema", False).csv(path)
    wide = wide.withColumn("_slot", F.monotonically_increasing_id())
    long = wide.unpivot("_slot", [c for c in wide.columns if c != "_slot"], "team", "player")
    out = long.where("player is not null and trim(player) <> ''").select("team", F.col("_slot").alias("slot"), "player")
    return out.withColumn("player", F.trim("player")) if strip else out


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, preferred, ordinal): normalised alias; a single cell maps to itself."""
    rows = spark.read.option("header", False).schema("alias string, preferred string").csv(path).withColumn("ordinal", F.monotonically_increasing_id())
    return rows.where("trim(alias) <> ''").select(lookup_key(F.col("alias")).alias("alias"), F.coalesce(F.when(F.trim("preferred") != "", F.trim("preferred")), F.trim("alias")).alias("preferred"), "ordinal")


def read_seasons(spark: SparkSession, path: str) -> DataFrame:
    """(filename, season, suffix, ordinal)"""
    rows = spark.read.option("header", True).schema("file_type string, filename string, season string, suffix string").csv(path)
    return rows.withColumn("ordinal", F.monotonically_increasing_id()).select("filename", "season", "suffix", "ordinal")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """(ts, player, rating) of a wide history; rows without a readable time are dropped."""
    wide = spark.read.option("header", True).csv(path)
    first = wide.columns[0]
    wide = wide.withColumnRenamed(first, "Time")
    long = wide.unpivot("Time", wide.columns[1:], "player", "rating")
    return long.select(parse_any_time(F.col("Time")).alias("ts"), "player", F.col("rating").try_cast("double").alias("rating")).where("ts is not null")


def existing_game_keys(games: DataFrame) -> DataFrame:
    """The (time, teams) keys that additions are held against."""
    return games.select("ts", F.least("team1", "team2").alias("lo"), F.greatest("team1", "team2").alias("hi")).distinct()


def load_config(path: str, strict: bool = True) -> dict | None:
    """A JSON configuration; without ``strict`` None on any error."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        if strict:
            raise
        return None
