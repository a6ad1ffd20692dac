"""Plans from files to results: pages to games and rosters, files to ratings, searches and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laddersmith.functions.names import is_placeholder, lookup_key
from laddersmith.functions.times import format_time, parse_any_time
from laddersmith.operators import aliases, folds, joins, stats
from laddersmith.plans import evaluation, export, history
from laddersmith.sources import csv_files, html_files, sinks


def games_of(spark: SparkSession, games_path: str, rosters_path: str, aliases_path: str | None = None, on_court: int = 8, known_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(games as the models read them, rosters) of a games file and a wide roster file. Players are their names."""
    rosters = csv_files.read_wide_rosters(spark, rosters_path)
    if aliases_path:
        rosters = joins.apply_aliases(rosters, csv_files.read_aliases(spark, aliases_path), lookup_key)
    games = csv_files.read_games(spark, games_path)
    if known_only:
        games = joins.matched_only(games, rosters)[0]
    return folds.prepare(joins.with_rosters(games, rosters), on_court), rosters


def ratings(spark: SparkSession, games_path: str, rosters_path: str, model: str, params: dict | None = None, aliases_path: str | None = None) -> DataFrame:
    """The rating history (ts, player, rating) of a model over files, with a first row for every player."""
    games, rosters = games_of(spark, games_path, rosters_path, aliases_path)
    return history.run_model(games, model, params, rosters)


def train(spark: SparkSession, games_path: str, rosters_path: str, config_path: str, mode: str = "both", model: str | None = None, trials: int | None = None, limit_eval_games: int | None = None, out: str | None = None) -> dict:
    """evaluation.train() over files; ``out``: where the best parameters are written as JSON."""
    config = csv_files.load_config(config_path)
    games, _ = games_of(spark, games_path, rosters_path, on_court=int(config.get("players_on_court_default", 8)), known_only=True)
    best = evaluation.train(games, config, mode, model, trials, limit_eval_games)
    if out:
        sinks.write_best(best, out)
    return best


def statistics(spark: SparkSession, games_path: str, rosters_path: str, model: str) -> DataFrame:
    """The parts of the statistics document over files."""
    games, rosters = games_of(spark, games_path, rosters_path)
    h = history.sequential_history(games, model) if model in history.SEQUENTIAL else history.batch_history(games, model)
    plain = csv_files.read_games(spark, games_path)
    exact = plain.withColumn("outcome_only", F.trim("outcome_raw") == "1").withColumn("tournament", F.trim("tournament_raw") == "1")
    return export.parts(h, exact, rosters.withColumn("player", F.trim("player")), model)


def sample_size_table(spark: SparkSession, games_path: str, rosters_path: str) -> DataFrame:
    """Each player's games and effective sample size, most games first. Scores may be any numbers here."""
    games = csv_files.read_games(spark, games_path).withColumn("score1", csv_files.float_of("score1_raw")).withColumn("score2", csv_files.float_of("score2_raw"))
    games = games.where("score1 is not null and score2 is not null")
    series = stats.outcome_series(games, csv_files.read_wide_rosters(spark, rosters_path))
    return stats.ess_report(stats.effective_sample_size(series, "player", ["ts", "game_id", "side", "team"], "x"))


def schedule_additions(spark: SparkSession, pages_path: str, games_path: str, seasons_path: str | None = None) -> DataFrame:
    """Raw rows (time, team1, score1, team2, score2) of the games file and of the pages' games that it lacks, in time order; unreadable times last."""
    found = html_files.read_schedules(html_files.html_files(spark, pages_path))
    if seasons_path:
        seasons = csv_files.read_seasons(spark, seasons_path)
        found = joins.with_season_suffix(joins.with_season_suffix(found, seasons, "team1"), seasons, "team2")
    cols = ["game_id", "ts", "time", "team1", "score1", "team2", "score2"]
    old = csv_files.read_games(spark, games_path).select("game_id", "ts", F.col("time_raw").alias("time"), "team1", F.col("score1_raw").alias("score1"), "team2", F.col("score2_raw").alias("score2"))
    # pages carry ISO times, files whole minutes
    found = found.withColumn("ts", F.date_trunc("minute", parse_any_time(F.col("time")))).withColumn("time", format_time(F.col("ts"))).withColumn("game_id", (1 << 62) + F.monotonically_increasing_id()).select(*cols)
    key = old.withColumn("ts", F.date_trunc("minute", "ts"))
    return sinks.merged_games(old, joins.new_games(found, key, within=True)).drop("game_id", "ts")


def roster_additions(spark: SparkSession, pages_path: str, rosters_path: str, aliases_path: str | None = None, seasons_path: str | None = None) -> DataFrame:
    """(team, slot, player): the roster file with the pages' teams in place of their old selves."""
    files = html_files.html_files(spark, pages_path)
    several = F.lower("html").contains("team-list")
    pages = html_files.read_rosters(files.where(~several)).unionByName(html_files.read_rosters(files.where(several), registrations=True))
    old = csv_files.read_wide_rosters(spark, rosters_path)
    managed = None
    if seasons_path:
        seasons = csv_files.read_seasons(spark, seasons_path)
        pages = joins.with_season_suffix(pages, seasons, "team")
        managed = pages.select(F.regexp_replace("team", joins.SEASON, "").alias("team"))
    new = pages.select("team", "slot", "player").where(~is_placeholder(F.col("player")))
    if aliases_path:
        new = joins.apply_aliases(new, csv_files.read_aliases(spark, aliases_path), lookup_key)
    return joins.upsert_teams(sinks.without_placeholders(old), joins.ordered_distinct(new), managed)


def canonical_rosters(spark: SparkSession, rosters_path: str, overrides: DataFrame | None = None, threshold: float = 0.72) -> tuple[DataFrame, DataFrame]:
    """(rosters with canonical names, pairs (alias, preferred) of the names that changed)."""
    rosters = csv_files.read_wide_rosters(spark, rosters_path)
    counts = stats.name_counts(rosters)
    names = aliases.canonical(counts, aliases.candidates(counts, threshold), overrides)
    changed = names.where("name <> canonical").select(F.col("name").alias("alias"), F.col("canonical").alias("preferred"))
    return joins.replace_cells(rosters, changed.withColumn("ordinal", F.lit(0))), changed
