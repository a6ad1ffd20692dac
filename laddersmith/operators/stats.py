"""Records, rating statistics, uncertainty and series diagnostics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from laddersmith.functions.pair_sums import PairSums
from laddersmith.functions.rating_math import player_sigma
from laddersmith.operators.joins import perspectives
from laddersmith.operators.order import numbered
from laddersmith.session import ship


def _record():
    w, d = F.col("own") > F.col("other"), F.col("own") == F.col("other")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return [F.count(F.lit(1)).alias("games"), one(w).alias("wins"), one(~w & ~d).alias("losses"), one(d).alias("draws")]


def team_records(games: DataFrame) -> DataFrame:
    """Games, wins, losses, draws, first and last time of each team over the games with two scores; a game against itself counts twice."""
    return perspectives(games.where("score1 is not null and score2 is not null")).groupBy("team").agg(*_record(), F.min("ts").alias("first_played"), F.max("ts").alias("last_played"))


def player_records(games: DataFrame, rosters: DataFrame) -> DataFrame:
    """The same for each player of the teams' rosters. Team sums are formed before the roster join, so it expands teams, not games."""
    t = team_records(games)
    total = lambda c: F.sum(c).cast("long").alias(c)
    return rosters.select("team", "player").distinct().join(t, "team").groupBy("player").agg(total("games"), total("wins"), total("losses"), total("draws"), F.max("last_played").alias("last_played"))


def games_per_player(games: DataFrame) -> DataFrame:
    """Appearances; ``games`` has r1 and r2."""
    return games.select(F.explode(F.concat("r1", "r2")).alias("player")).groupBy("player").agg(F.count(F.lit(1)).alias("games"))


def player_teams(rosters: DataFrame) -> DataFrame:
    return rosters.groupBy("player").agg(F.array_sort(F.collect_set("team")).alias("teams"))


def distinct_players(rosters: DataFrame) -> DataFrame:
    """All players of the rosters, in order."""
    return rosters.select("player").where("player is not null").distinct().orderBy("player")


def name_counts(cells: DataFrame) -> DataFrame:
    return cells.withColumn("name", F.trim("player")).where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def first_seen(games: DataFrame) -> DataFrame:
    return perspectives(games.where("ts is not null")).groupBy("team").agg(F.min("ts").alias("first_ts"))


def rating_summary(history: DataFrame) -> DataFrame:
    """Current, peak and lowest rating of each player; rows without a time are the last ones."""
    return history.groupBy("player").agg(F.max_by("rating", F.struct(F.col("ts").isNull(), "ts", "game_id")).alias("current"), F.max("rating").alias("peak"), F.min("rating").alias("lowest"))


def team_history(history: DataFrame, rosters: DataFrame, default: float = 1000.0) -> DataFrame:
    """Mean rating of the members present at each time; teams without any get the default once."""
    h = history.where(~F.isnan("rating")).join(rosters.select("team", "player").distinct(), "player").groupBy("team", "ts").agg(F.avg("rating").alias("rating"))
    bare = rosters.select("team").distinct().join(h.select("team").distinct(), "team", "left_anti").select("team", F.lit(None).cast("timestamp").alias("ts"), F.lit(default).alias("rating"))
    return h.unionByName(bare)


def last_per_time(rows: DataFrame) -> DataFrame:
    """Of rows at one time, the one of the last game."""
    w = Window.partitionBy("ts").orderBy(F.desc("game_id"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def roster_overlap(rosters: DataFrame) -> DataFrame:
    """(team1 < team2, shared, jaccard) of teams that share players: a self-join on the player, never all pairs."""
    r = rosters.select("team", "player").distinct()
    size = r.groupBy("team").agg(F.count(F.lit(1)).alias("n"))
    a, b = r.select(F.col("team").alias("team1"), "player"), r.select(F.col("team").alias("team2"), "player")
    pair = a.join(b, "player").where("team1 < team2").groupBy("team1", "team2").agg(F.count(F.lit(1)).alias("shared"))
    out = pair.join(size.select(F.col("team").alias("team1"), F.col("n").alias("n1")), "team1").join(size.select(F.col("team").alias("team2"), F.col("n").alias("n2")), "team2")
    return out.select("team1", "team2", "shared", (F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared"))).alias("jaccard"))


def team_order(games: DataFrame) -> DataFrame:
    """(team, pos): the order in which teams first appear; team 1 stands before team 2."""
    p = perspectives(games).groupBy("team").agg(F.min(F.struct(F.col("ts").isNull().alias("n"), "ts", "game_id", "side")).alias("pos"))
    return p


def diversity(games: DataFrame, rosters: DataFrame) -> DataFrame:
    """(player, complexity, sigma): 1 for the first team, 1 less the highest overlap with an earlier one for each later team."""
    return diversity_of(rosters.select("team", "player").distinct().join(team_order(games), "team"))


def diversity_of(mine: DataFrame) -> DataFrame:
    """The same of (team, player, pos), distinct by team and player: a player's teams stand in the order of ``pos``."""
    over = roster_overlap(mine)
    both = over.select(F.col("team1").alias("team"), F.col("team2").alias("other"), "jaccard").unionByName(over.select(F.col("team2").alias("team"), F.col("team1").alias("other"), "jaccard"))
    other = mine.select("player", F.col("team").alias("other"), F.col("pos").alias("other_pos"))
    later = mine.join(other, "player").where("other_pos < pos").join(both, ["team", "other"], "left")
    near = later.groupBy("player", "team").agg(F.max(F.coalesce("jaccard", F.lit(0.0))).alias("near"))
    out = mine.join(near, ["player", "team"], "left").groupBy("player").agg(F.sum(1 - F.coalesce("near", F.lit(0.0))).alias("complexity"))
    return out.withColumn("sigma", F.expr(player_sigma("complexity")))


def team_variance(rosters: DataFrame, sigmas: DataFrame) -> DataFrame:
    """Sum of squared sigmas over the squared size; players without sigma count 1."""
    j = rosters.select("team", "player").distinct().join(sigmas.select("player", "sigma"), "player", "left")
    return j.groupBy("team").agg((F.sum(F.pow(F.coalesce("sigma", F.lit(1.0)), 2)) / F.pow(F.count(F.lit(1)), 2)).alias("variance"))


def head_to_head(ratings: DataFrame, sigma: float = 4.2458, best: float = 2000.0) -> DataFrame:
    """(player, rating): the mean probability to beat each other active player, times ``best``.

    ``ratings``: (player, theta, sigma, active). Every pair counts by definition; the sums over pairs go through points whose number follows from the skills' range (pair_sums):
    each partition adds up its players' moments, and every player reads its sum off the points. Work grows with the players, not with their pairs.
    """
    ship(ratings.sparkSession)
    act = ratings.where("active").select("player", F.col("theta").cast("double").alias("theta"), (F.col("sigma") * F.col("sigma")).cast("double").alias("variance"))
    n, *ends = act.agg(F.count(F.lit(1)), F.min("theta"), F.max("theta"), F.min("variance"), F.max("variance")).first()
    if n < 2:
        return ratings.select("player", F.when(F.col("active"), F.lit(best)).otherwise(best / 2).alias("rating"))
    points = PairSums(*ends, sigma)

    def weigh(batches):
        total = np.zeros((points.x.n, points.v.n))
        for b in batches:
            total += points.moments(b.column(0).to_numpy(), b.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "w"])

    moments = np.zeros(points.points)
    for r in act.select("theta", "variance").mapInArrow(weigh, "i long, w double").groupBy("i").agg(F.sum("w").alias("w")).collect():  # a number for each point
        moments[r.i] = r.w
    curve = points.curve(moments.reshape(points.x.n, points.v.n))
    points.kept.clear()
    kind = ratings.schema["player"].dataType

    def read(batches):
        for b in batches:
            s = points.sums(b.column(1).to_numpy(), b.column(2).to_numpy(), curve)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((s - 0.5) / (n - 1) * best)], names=["player", "rating"])

    own = act.mapInArrow(read, f"player {kind.simpleString()}, rating double")
    return own.unionByName(ratings.where("active is null or not active").select("player", F.lit(best / 2).alias("rating")))


def effective_sample_size(series: DataFrame, key: str, order: list[str], value: str, lags: int = 50) -> DataFrame:
    """(key, n, ess): n / (1 + 2 * sum of autocorrelations up to the first that isn't positive).

    Each key's values stream in order through running sums of the lagged products, which need the last ``lags`` values alone, so no task holds a series.
    """
    ship(series.sparkSession)
    rows = series.select(key, *[c for c in order if c != key], F.col(value).cast("double").alias("_x")).where("_x is not null")
    kind = series.schema[key].dataType
    rows = rows.repartition(key).sortWithinPartitions(key, *order, "_x").select(F.col(key).alias("k"), "_x")

    def run(batches):
        now, sums = None, None
        keys, ns, out = [], [], []
        for b in batches:
            k, x = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)
            i = 0
            while i < len(k):
                j = i + 1
                while j < len(k) and k[j] == k[i]:
                    j += 1
                if sums is None or k[i] != now:
                    if sums is not None:
                        keys.append(now)
                        ns.append(sums.n)
                        out.append(sums.ess())
                    now, sums = k[i], Lagged(lags)
                sums.add(x[i:j])
                i = j
        if sums is not None:
            keys.append(now)
            ns.append(sums.n)
            out.append(sums.ess())
        yield pa.RecordBatch.from_arrays([pa.array(keys, to_arrow_type(kind)), pa.array(ns, pa.int64()), pa.array(out, pa.float64())], names=["k", "n", "ess"])

    return rows.mapInArrow(run, f"k {kind.simpleString()}, n long, ess double").withColumnRenamed("k", key)


class Lagged:
    """Running sums of a series and of its products at each lag, around its first value."""

    def __init__(self, lags: int):
        self.n, self.first, self.total, self.square = 0, 0.0, 0.0, 0.0
        self.products = np.zeros(lags + 1)
        self.head = np.zeros(0)  # the first and the last values, as many as there are lags
        self.tail = np.zeros(0)

    def add(self, x: np.ndarray) -> None:
        if not self.n:
            self.first = float(x[0])
        x = x - self.first
        lags = len(self.products) - 1
        both = np.concatenate([self.tail, x])
        old = len(self.tail)
        for k in range(1, min(lags, len(both) - 1) + 1):
            lo = max(old, k)
            self.products[k] += both[lo:] @ both[lo - k : len(both) - k]
        self.n += len(x)
        self.total += x.sum()
        self.square += x @ x
        self.head = np.concatenate([self.head, x])[:lags]
        self.tail = both[-lags:]

    def ess(self) -> float:
        n = self.n
        mean = self.total / n
        c0 = (self.square - n * mean * mean) / n
        if n <= 1:
            return float(n)
        if c0 <= 1e-12 * self.square / n:
            return float("nan")
        out, head, tail = 0.0, np.cumsum(self.head), np.cumsum(self.tail[::-1])
        for k in range(1, min(len(self.products) - 1, n - 1) + 1):
            # sum over i of (x[i] - mean) * (x[i + k] - mean): the first factors leave out the last k values, the second ones the first k
            s = self.products[k] - mean * (2 * self.total - tail[k - 1] - head[k - 1]) + (n - k) * mean * mean
            r = s / (n - k) / c0
            if r <= 0:
                break
            out += r
        return n / (1 + 2 * out)


def ess_report(ess: DataFrame, key: str = "player") -> DataFrame:
    """The table for people: most games first, three decimals."""
    return ess.select(key, "n", F.round("ess", 3).alias("ess")).orderBy(F.desc("n"), key)


def ess_summary(ess: DataFrame) -> DataFrame:
    return ess.agg(F.count(F.lit(1)).alias("players"), F.median("n").alias("median_n"), F.median(F.when(~F.isnan("ess"), F.col("ess"))).alias("median_ess"), F.count_if(F.col("n") >= 20).alias("many_games"), F.count_if((F.col("ess") < 10) & ~F.isnan("ess")).alias("low_ess"))


def outcome_series(games: DataFrame, rosters: DataFrame) -> DataFrame:
    """Each player's outcomes in order: 1, 0 or 0.5."""
    x = F.when(F.col("own") > F.col("other"), 1.0).when(F.col("own") < F.col("other"), 0.0).otherwise(0.5)
    return perspectives(games).withColumn("x", x).join(rosters.select("team", "player").distinct(), "team").select("player", "ts", "game_id", "side", "team", "x")


def compare_ratings(a: DataFrame, b: DataFrame, top: int = 15) -> tuple[DataFrame, DataFrame]:
    """The largest differences of two rating tables (player, rating), and their summary with both correlations."""
    j = a.select("player", F.col("rating").alias("x")).join(b.select("player", F.col("rating").alias("y")), "player").withColumn("gap", F.abs(F.col("x") - F.col("y")))
    rank = lambda c: _mean_rank(j, c)
    r = rank("x").join(rank("y"), "player")
    s = j.agg(F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"), F.corr("x", "y").alias("pearson")).crossJoin(r.agg(F.corr("rank_x", "rank_y").alias("spearman")))
    return j.orderBy(F.desc("gap"), "player").limit(top), s


def _mean_rank(j: DataFrame, c: str) -> DataFrame:
    """Mean ranks from running counts of the distinct values, range by range."""
    v = j.groupBy(c).agg(F.count(F.lit(1)).alias("k"))
    v = numbered(v, F.col(c).asc(), name="_below", weight=F.col("k")).withColumn("rank_" + c, F.col("_below") - (F.col("k") - 1) / 2)
    return j.join(v.select(c, "rank_" + c), c).select("player", "rank_" + c)
