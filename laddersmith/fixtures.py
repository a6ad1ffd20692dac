"""Games and rosters as views over the synthetic tables, for Spark and (as SQL) for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

_ROSTERS = """SELECT concat('N', c_nationkey, '-', c_mktsegment) AS team, c_custkey AS player FROM customer
UNION SELECT concat('N', (c_nationkey + 1) % 25, '-', c_mktsegment), c_custkey FROM customer WHERE c_custkey % 7 = 0"""

_GAMES = """SELECT o_orderkey AS game_id, CAST(o_orderdate AS timestamp) AS ts, concat('N', c_nationkey, '-', c_mktsegment) AS team1,
  concat('N', (o_orderkey {div} 20) % 25, '-', CASE (o_orderkey {div} 500) % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END) AS team2,
  coalesce(l.s1, 0) AS score1, coalesce(l.s2, 0) AS score2,
  CASE WHEN o_orderstatus = 'P' THEN '1' ELSE '' END AS outcome_only, CASE WHEN o_orderpriority = '1-URGENT' THEN '1' ELSE '' END AS tournament
FROM orders JOIN customer ON c_custkey = o_custkey
LEFT JOIN (SELECT l_orderkey, count(CASE WHEN l_returnflag = 'A' THEN 1 END) s1, count(CASE WHEN l_returnflag = 'R' THEN 1 END) s2 FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o_orderkey"""

#: The start of a DuckDB WITH clause that defines rosters and games.
CTE = f"rosters AS ({_ROSTERS}), games AS ({_GAMES.format(div='//')})"


def register(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(team, player)"""
    register(spark, sf_dir, "customer")
    return spark.sql(_ROSTERS)


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(game_id, ts, team1, team2, score1, score2, outcome_only, tournament): every order is a game."""
    register(spark, sf_dir, "customer", "orders", "lineitem")
    return spark.sql(_GAMES.format(div="div"))
