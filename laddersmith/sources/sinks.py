"""Writers: long Parquet first; wide CSV and JSON documents at the edge."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laddersmith.functions.names import is_placeholder
from laddersmith.functions.times import format_time
from laddersmith.operators import intervals


def wide_history(history: DataFrame, players: DataFrame | None = None, default: float | None = None) -> DataFrame:
    """(block, at, line): the wide history, filled: a line for each time and a column for each player, in blocks of columns.

    ``history``: (ts, player, rating), changes only; every cell has the last rating at or before its time, or ``default``."""
    marks = intervals.changes(history, "player")
    return intervals.wide_lines(*intervals.filled(marks, "player", players, default), "player", format_time)


def write_wide(lines: DataFrame, path: str) -> None:
    """wide_history() as text: a folder for each block of columns, with one CSV file in it."""
    ordered = lines.repartition("block").sortWithinPartitions("block", "at")
    ordered.select("block", "line").write.mode("overwrite").partitionBy("block").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A single CSV file for people; tables for programs stay in Parquet."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def swap_in(df: DataFrame, path: str, keep_backup: bool = True) -> None:
    """Write beside ``path``, then rename over it; the old directory becomes a backup."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new = f"{path}.{uuid.uuid4().hex}.tmp"
    df.write.parquet(new)
    old, target, source = (jvm.org.apache.hadoop.fs.Path(p) for p in (path + ".backup", path, new))
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        fs.delete(old, True)
        fs.rename(target, old)
        if not keep_backup:
            fs.delete(old, True)
    fs.rename(source, target)


def merged_games(existing: DataFrame, additions: DataFrame) -> DataFrame:
    """All games in time order, those without time last."""
    return existing.unionByName(additions).orderBy(F.col("ts").asc_nulls_last(), "game_id")


def without_placeholders(rosters: DataFrame) -> DataFrame:
    return rosters.where(~is_placeholder(F.col("player")))


def wide_rosters(rosters: DataFrame, teams: list[str]) -> DataFrame:
    return rosters.groupBy("slot").pivot("team", teams).agg(F.first("player")).orderBy("slot")


def unseen_aliases(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs to append: (alias, preferred) that aren't there yet."""
    return found.select("alias", "preferred").distinct().join(existing.select("alias", "preferred"), ["alias", "preferred"], "left_anti")


def write_best(best: dict, path: str) -> None:
    """The best parameters and metrics of each model as JSON."""
    Path(path).write_text(json.dumps(best, indent=2, sort_keys=True), encoding="utf-8")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): the numbers of a histogram."""
    return df.where(f"not isnan({column})").groupBy(F.expr(f"width_bucket({column}, {low}D, {high}D, {bins})").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
