"""Logistic model of players and team stints, with stratified cross-validation."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def features(games: DataFrame) -> DataFrame:
    """(game_id, label, terms, signs): +1 for side 1's players and its team's year, -1 for side 2's; draws are left out.

    A player who stands for n (mates.py) has their root: with their common coefficient times it, the n equal columns and their ridge are this one's."""
    count = lambda r: r.replace("r", "n")
    root = lambda r, i: F.sqrt(F.get(F.col(count(r)), i).cast("double")) if count(r) in games.columns else F.lit(1.0)
    side = lambda r, t, sign: F.concat(F.transform(r, lambda p, i: F.struct(F.concat(F.lit("p:"), p.cast("string")).alias("f"), (sign * root(r, i)).alias("x"))), F.array(F.struct(F.concat(F.lit("s:"), F.col(t), F.lit("::"), F.year("ts")).alias("f"), F.lit(sign).alias("x"))))
    g = games.where("s1 <> s2 and size(r1) > 0 and size(r2) > 0 and ts is not null")
    return g.select("game_id", (F.col("s1") > F.col("s2")).cast("double").alias("label"), F.concat(side("r1", "team1", 1.0), side("r2", "team2", -1.0)).alias("fx"))


def vectors(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    cv = CountVectorizer(inputCol="terms", outputCol="_cv", vocabSize=1 << 22).fit(rows.select(F.transform("fx", lambda s: s["f"]).alias("terms")))
    at = {t: i for i, t in enumerate(cv.vocabulary)}
    b = rows.sparkSession.sparkContext.broadcast(at)  # as large as the coefficient vector, which the fit sends too

    @F.udf(VectorUDT())
    def vec(fx):
        out: dict[int, float] = {}
        for s in fx:
            i = b.value[s["f"]]
            out[i] = out.get(i, 0.0) + s["x"]
        return SparseVector(len(b.value), {i: v for i, v in out.items() if v})

    return rows.select("game_id", "label", vec("fx").alias("features")), cv.vocabulary


def fit(games: DataFrame, folds: int = 5, seed: int = 42, c: float = 1.0) -> tuple[DataFrame, list[float]]:
    """(feature, mean, std) of the coefficients over the folds' fits, and the accuracy of each."""
    rows = features(games)
    w = Window.partitionBy("label").orderBy(F.xxhash64("game_id", F.lit(seed)))
    v, names = vectors(rows)
    v = v.withColumn("fold", F.pmod(F.row_number().over(w), F.lit(folds))).persist()
    coefs, acc = [], []
    for k in range(folds):
        train, test = v.where(F.col("fold") != k), v.where(F.col("fold") == k)
        n = train.count()
        m = LogisticRegression(fitIntercept=False, standardization=False, elasticNetParam=0.0, regParam=1 / (c * max(n, 1)), maxIter=200, tol=1e-8).fit(train)
        coefs.append([float(x) for x in m.coefficients.toArray()])
        acc.append(m.transform(test).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).head()[0])
    v.unpersist()
    spark = games.sparkSession
    table = spark.createDataFrame([(n, [c[i] for c in coefs]) for i, n in enumerate(names)], "feature string, xs array<double>")
    out = table.select("feature", F.explode("xs").alias("x")).groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return out, acc


def for_everyone(coefficients: DataFrame, members: DataFrame) -> DataFrame:
    """The coefficients of a fit to players who stand for their mates, as those of all players and team years."""
    player = F.col("feature").startswith("p:")
    mine = members.select(F.concat(F.lit("p:"), F.col("stand").cast("string")).alias("feature"), F.concat(F.lit("p:"), F.col("player").cast("string")).alias("own"), F.sqrt(F.count(F.lit(1)).over(Window.partitionBy("stand")).cast("double")).alias("root"))
    own = coefficients.where(player).join(mine, "feature").select(F.col("own").alias("feature"), (F.col("mean") / F.col("root")).alias("mean"), (F.col("std") / F.col("root")).alias("std"))
    return coefficients.where(~player).unionByName(own)
