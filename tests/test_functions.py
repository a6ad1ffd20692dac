import math
import random

from pyspark.sql import functions as F

from laddersmith.functions import names, rating_math, scores, times


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).head().x


def test_normal_cdf(spark):
    xs = [i / 16 for i in range(-640, 641)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", F.expr(rating_math.normal_cdf("x")).alias("p"))
    got = {r.x: r.p for r in df.collect()}
    assert max(abs(got[x] - rating_math.phi(x)) for x in xs) < 1e-12
    assert all(abs(got[x] + got[-x] - 1) < 1e-12 for x in xs)


def test_times(spark):
    rows = [("1/2/2024 3:04:05", "2024-01-02 03:04:05"), (" 12/31/2023 ", "2023-12-31 00:00:00"), ("1/2/68 1:02", "2068-01-02 01:02:00"), ("1/2/69", "1969-01-02 00:00:00"), ("2024-01-02", None), ("", None), (None, None), ("13/40/2020", None)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(F.date_format(times.parse_time(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("x"))
    assert [r.x for r in df.collect()] == [x for _, x in rows]
    assert one(spark, times.format_time(F.lit("2024-01-02 03:04:05").cast("timestamp"))) == "1/2/2024 3:04:00"


def test_scores(spark):
    rows = ["3", " 3 ", "+3", "-3", "3.0", "", None, "x"]
    df = spark.createDataFrame([(t,) for t in rows], "t string").select(scores.strict_int(F.col("t")).alias("a"), scores.model_score(F.col("t")).alias("b"), scores.float_score(F.col("t")).alias("c"))
    assert [r.a for r in df.collect()] == [3, 3, 3, -3, None, None, None, None]
    assert [r.b for r in df.collect()] == [3, 3, 3, 0, 0, 0, 0, 0]
    assert [r.c for r in df.collect()] == [3.0, 3.0, 3.0, -3.0, 3.0, None, None, None]
    a, b = scores.elo_scores(F.lit("x"), F.lit("2"), F.lit(True))
    assert (one(spark, a), one(spark, b)) == (1, 0)


def test_names(spark):
    # only the white space before the scores and the "vs" go collapses first; what they leave stays
    for text, want in (("Blue  Team 3-2 vs Red | Fall", "Blue Team   Red"), ("A 3 - 2 B", "A 3 - 2 B"), ("Vs. Ann v. Bo", "Ann  Bo"), ("Team  |x", "Team"), ("Lavs", "Lavs")):
        assert one(spark, names.clean_team_name(F.lit(text))) == names.team_name(text) == want
    for text, want in (("Blue Team (F23) - Fall.html", "Blue Team"), ("Red ｜ League.htm", "Red"), ("v1.2 Team", "v1"), (".hidden", ".hidden"), ("A-B (x)", "A-B")):
        assert one(spark, names.clean_header(F.lit(text))) == names.header_of_file(text) == want
    assert all(names.placeholder(x) == one(spark, names.is_placeholder(F.lit(x))) for x in ("", "Add", "Search player...", "Ann", "add-", "Create new user x"))
    assert one(spark, names.lookup_key(F.lit(" José--Peña_3 "))) == "josé peña 3"
    assert one(spark, names.alias_key(F.lit("José (Joe) O'Peña-Cruz"))) == "jose joe openacruz"
    assert one(spark, names.last_name(F.lit("Ann B. Cole"))) == "cole"
    assert one(spark, names.similarity(F.lit("abcd"), F.lit("bcde"))) == 0.75
    assert [one(spark, names.is_placeholder(F.lit(x))) for x in ("", "Add", "Search player...", "Ann")] == [True, True, True, False]


def test_formulas(spark):
    rng = random.Random(1)
    d = rng.uniform(-3, 3)
    w, lo, dr = (one(spark, F.expr(e)) for e in rating_math.davidson(f"{d}D", 0.4))
    assert math.isclose(w + lo + dr, 1)
    assert math.isclose(one(spark, F.expr(rating_math.elo_expected("1200D", "1000D"))), 1 / (1 + 10 ** (-0.5)))
    assert [one(spark, F.expr(rating_math.goal_factor(str(m)))) for m in (0, 1, 2, 3)] == [1, 1, 1.5, 1.75]
