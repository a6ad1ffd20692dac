"""One maximum-a-posteriori fit of all games, over partitions: no task holds a league.

Games are packed once, in blocks, with the players' places and coefficients; that is the only work that shuffles games, in proportion to them.
Newton's method runs with conjugate gradients, scaled by the curvature's diagonal: the loss with its slope, and each product
of the curvature with a direction, are one pass over the blocks, whose partial sums Spark adds up by player.
The driver holds vectors of a number for each player (as MLlib's linear models do), up to ``MOST`` of them; beyond that it refuses.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laddersmith.operators.map_models import BatchModel
from laddersmith.operators.order import numbered
from laddersmith.operators.stats import diversity_of, head_to_head
from laddersmith.plans.registry import make
from laddersmith.session import materialize, parallelism, ship

#: Players of one fit at most: vectors of half a GB each.
MOST = 1 << 26
#: A block's columns and their types.
KINDS = {"sizes": np.int32, "at": np.int32, "coef": np.float64, "y": np.float64, "m": np.float64, "margin": np.bool_, "noise": np.float64, "weight": np.float64, "times": np.float64}


def occurrences(games: DataFrame, replace: bool) -> DataFrame:
    """(game_id, player, n, side, val): 1 / n for each player of side 1, less 1 / n for those of side 2. With ``replace`` what a player
    has on side 1 is taken back where they are on side 2 as well (side 3). A player who stands for ``n`` (mates.py) has that of all."""
    for k in (1, 2):
        if f"n{k}" not in games.columns:
            games = games.withColumn(f"n{k}", F.transform(f"r{k}", lambda p: F.lit(1)))
    total = lambda k: F.aggregate(f"n{k}", F.lit(0).cast("long"), lambda a, x: a + x)
    both = lambda k: F.zip_with(f"r{k}", f"n{k}", lambda p, n: F.struct(p.alias("player"), n.alias("n")))
    side = lambda k, who, sign, size: games.select("game_id", F.explode(who).alias("x"), F.lit(k).alias("side"), size.alias("size")).select("game_id", "x.player", "x.n", "side", (sign * F.col("x.n") / F.col("size")).alias("val"))
    out = side(1, both(1), 1, total(1)).unionByName(side(2, both(2), -1, total(2)))
    return out.unionByName(side(3, F.filter(both(1), lambda x: F.array_contains("r2", x["player"])), -1, total(1))) if replace else out


def sigmas(games: DataFrame) -> DataFrame:
    """(player, sigma) by the diversity of the teams for which each player played, in the order of each player's own first games."""
    late = F.col("ts").isNull()
    side = lambda k: games.select(F.col(f"team{k}").alias("team"), F.explode(f"r{k}").alias("player"), F.struct(late.alias("late"), "ts", "game_id", F.lit(k).alias("side")).alias("pos"))
    mine = side(1).unionByName(side(2)).groupBy("team", "player").agg(F.min("pos").alias("pos"))
    return diversity_of(materialize(mine, "batch-fit")).select("player", F.greatest("sigma", F.lit(1e-8)).alias("sigma"))


def _weight(games: DataFrame, name: str, model: BatchModel):
    if name == "bt_mov_time_decay":
        ref = games.agg(F.max("day")).head()[0] or 0.0
        weeks = F.coalesce(F.greatest(F.lit(0.0), F.lit(ref) - F.col("day")) / 7, F.lit(0.0))
        return (1 + F.log1p(F.abs("m"))) * F.pow(F.lit(float(model.decay)), weeks)
    return F.when(F.col("tournament"), 2.0).otherwise(1.0) if name in ("bt_uncert", "bt_normal") else F.lit(1.0)


def packed(games: DataFrame, name: str, model: BatchModel, index: DataFrame, spread: DataFrame | None) -> DataFrame:
    """The games that have players, in blocks of KINDS: a block has the rows of one Arrow batch."""
    occ = occurrences(games, model.REPLACE).join(index, "player")
    if spread is not None:
        occ = occ.join(spread, "player")
    var = F.when(F.col("side") < 3, F.col("val") * F.col("val") * F.col("sigma") * F.col("sigma") / F.col("n")) if spread is not None else F.lit(0.0)
    sides = occ.groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("at", "val"))).alias("x"), F.sum(var).alias("variance"))
    score = lambda k: F.greatest(F.coalesce(F.col(f"s{k}"), F.lit(0)), F.lit(0))
    facts = games.select("game_id", "day", "tournament", "outcome_only", (score(1) - score(2)).cast("double").alias("m"))
    noise = F.sqrt(F.greatest(F.lit(float(model.sigma) ** 2) + F.col("variance"), F.lit(1e-8))) if spread is not None else F.lit(float(model.noise_of_all()))
    rows = sides.join(facts, "game_id").select(
        F.col("x.at").alias("at"), F.col("x.val").alias("coef"), F.signum("m").alias("y"), "m", ((F.col("m") != 0) & ~F.coalesce("outcome_only", F.lit(False))).alias("margin"),
        noise.alias("noise"), _weight(games, name, model).alias("weight"),
    )
    # games of players who stand for others are often equal: they are one row with their number; where they weigh by their age, with all their weight
    if "n1" not in games.columns:
        rows = rows.withColumn("times", F.lit(1.0))
    elif name == "bt_mov_time_decay":
        rows = rows.groupBy(*[c for c in rows.columns if c != "weight"]).agg(F.sum("weight").alias("weight")).withColumn("times", F.lit(1.0))
    else:
        rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).cast("double").alias("times"))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            at, coef = b.column("at"), b.column("coef")
            out = {"sizes": np.diff(at.offsets.to_numpy()), "at": at.flatten().to_numpy(zero_copy_only=False), "coef": coef.flatten().to_numpy(zero_copy_only=False)}
            out |= {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "m", "margin", "noise", "weight", "times")}
            yield pa.RecordBatch.from_arrays([pa.array([out[c].astype(k).tobytes()], pa.binary()) for c, k in KINDS.items()], names=list(KINDS))

    return materialize(rows.repartition(parallelism(games.sparkSession)).mapInArrow(run, ", ".join(f"{c} binary" for c in KINDS)), "batch-fit")


@dataclass
class Sums:
    """Sums over all games; each is one pass over the blocks."""

    blocks: DataFrame
    n: int
    model: BatchModel
    passes: int = 0

    def slope(self, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, gradient, and the curvature's diagonal."""
        return self._sum(theta, None)

    def curve(self, theta: np.ndarray, direction: np.ndarray) -> np.ndarray:
        """The curvature at ``theta`` times ``direction``."""
        return self._sum(theta, direction)[1]

    def _sum(self, theta: np.ndarray, direction: np.ndarray | None) -> tuple[float, np.ndarray, np.ndarray]:
        self.passes += 1
        sent = self.blocks.sparkSession.sparkContext.broadcast((theta, direction))
        model, n = self.model, self.n

        def run(batches):
            theta, direction = sent.value
            total, g, h = 0.0, np.zeros(n), np.zeros(n)
            for b in batches:
                for r in range(b.num_rows):
                    x = {c: np.frombuffer(b.column(c)[r].as_buffer(), k) for c, k in KINDS.items()}
                    games, at, coef = len(x["sizes"]), x["at"], x["coef"]
                    row = np.repeat(np.arange(games), x["sizes"])
                    loss, slope, curve = (x["times"] * part for part in model.terms(x["y"], x["m"], x["margin"], x["noise"], x["weight"])(np.bincount(row, coef * theta[at], games)))
                    if direction is None:
                        total += float(loss.sum())
                        np.add.at(g, at, coef * slope[row])
                        np.add.at(h, at, coef * coef * curve[row])
                    else:
                        np.add.at(g, at, coef * (curve * np.bincount(row, coef * direction[at], games))[row])
            some = np.flatnonzero((g != 0) | (h != 0))
            at = np.append(some, -1)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(g[some], total)), pa.array(np.append(h[some], 0.0))], names=["i", "g", "h"])

        got = self.blocks.mapInArrow(run, "i long, g double, h double").groupBy("i").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        sent.destroy()
        i, a, b = (got.column(c).to_numpy() for c in ("i", "g", "h"))
        g, h = np.zeros(n), np.zeros(n)
        own = i >= 0
        g[i[own]], h[i[own]] = a[own], b[own]
        return float(a[~own].sum()), g, h


def newton(sums: Sums, ridge: np.ndarray, theta: np.ndarray, tol: float = 1e-8) -> np.ndarray:
    """The least loss plus ``ridge`` times theta squared, to a gradient below ``tol``."""

    def at(t):
        loss, g, h = sums.slope(t)
        return loss + float((ridge * t**2).sum()), g + 2 * ridge * t, h + 2 * ridge

    total, grad, diag = at(theta)
    for _ in range(100):
        worst = np.abs(grad).max(initial=0)
        if worst < tol:
            break
        step, r = np.zeros_like(theta), -grad
        z = r / np.maximum(diag, 1e-12)
        p, rz = z.copy(), float(r @ z)
        # as exact as the way that is left makes worth while
        enough = max(0.1 * tol, min(0.1, math.sqrt(worst)) * worst)
        for _ in range(4 * len(theta) + 20):
            hp = sums.curve(theta, p) + 2 * ridge * p
            curve = float(p @ hp)
            if curve <= 0:
                break
            a = rz / curve
            step += a * p
            r = r - a * hp
            if np.abs(r).max() < enough:
                break
            z = r / np.maximum(diag, 1e-12)
            rz, old = float(r @ z), rz
            p = z + rz / old * p
        size = 1.0
        while size > 1e-10:
            new = at(theta + size * step)
            if new[0] <= total + 1e-4 * size * float(grad @ step) + 1e-13 * abs(total):
                theta = theta + size * step
                total, grad, diag = new
                break
            size /= 2
        else:
            break
    return theta


def batch_ratings(games: DataFrame, model: str, params: dict | None = None) -> DataFrame:
    """(player, theta, rating): one fit of all games (as of prepare()) by a batch model.

    Without players an empty result; games without players change nothing but the time that decay counts back from. Players tie and
    repeat in rosters as they do in the model's own fit. Of games of players who stand for their mates, bt_uncert takes none: its diversity compares whole rosters.
    """
    if model == "bt_uncert" and "n1" in games.columns:
        raise ValueError("bt_uncert fits games with whole rosters")
    spark = games.sparkSession
    ship(spark)
    m = make(model, params)
    seen = occurrences(games, False).groupBy("player").agg(F.count(F.lit(1)).alias("appearances"), F.max("n").alias("n"))
    index = materialize(numbered(seen, F.col("player"), name="_pos").select("player", "appearances", "n", (F.col("_pos") - 1).cast("int").alias("at")), "batch-fit")
    n = index.count()
    if n > MOST:
        raise ValueError(f"{n} players: a fit takes {MOST} at most")
    spread = materialize(sigmas(games), "batch-fit") if model == "bt_uncert" else None
    values = np.zeros(n)
    if n:
        blocks = packed(games, model, m, index.select("player", "at"), spread).persist(StorageLevel.MEMORY_AND_DISK)
        values = _fit(Sums(blocks, n, m), model, m, index)
        blocks.unpersist()
    sent, scale = spark.sparkContext.broadcast(values), getattr(m, "spread", 200.0) / (m.tau if model == "bt_normal" else 1.0)

    def read(batches):
        for b in batches:
            theta = sent.value[b.column(1).to_numpy()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(theta), pa.array(1000.0 + scale * theta)], names=["player", "theta", "rating"])

    kind = index.schema["player"].dataType.simpleString()
    out = index.select("player", "at").mapInArrow(read, f"player {kind}, theta double, rating double")
    if model != "bt_uncert":
        return out
    out = materialize(out.drop("rating"), "batch-fit")
    return out.join(head_to_head(out.join(spread, "player").withColumn("active", F.lit(True)), m.sigma, m.best), "player")


def _fit(sums: Sums, name: str, m: BatchModel, index: DataFrame) -> np.ndarray:
    theta = np.zeros(sums.n)
    t = index.select("at", "appearances", "n").toArrow()
    seen, n = np.zeros(sums.n), np.zeros(sums.n)
    seen[t.column("at").to_numpy()], n[t.column("at").to_numpy()] = t.column("appearances").to_numpy(), t.column("n").to_numpy()
    if name == "bt_vet":
        return newton(sums, n * m.ridge(seen), theta)
    if name != "bt_normal":
        return newton(sums, n * m.lam, theta)
    # the scale that agrees with its own fit, by secants: plain repetition needs some thirty fits
    tau2, past = m.tau**2, None
    for _ in range(200):
        theta = newton(sums, n / (2 * tau2), theta)
        new = (float((n * theta**2).sum()) + 2 * m.b) / (n.sum() + m.a)
        if abs(new - tau2) < 1e-10 * tau2:
            break
        guess = new
        if past is not None and past[1] != new - tau2:
            secant = tau2 - (new - tau2) * (tau2 - past[0]) / (new - tau2 - past[1])
            if new / 4 < secant < 4 * new:
                guess = secant
        tau2, past = guess, (tau2, new - tau2)
    m.tau = math.sqrt(tau2)
    return theta
