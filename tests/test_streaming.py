from laddersmith.operators.folds import catalyst_elo
from laddersmith.streaming.online_elo import online_elo


def test_online_elo_equals_the_fold(spark, tmp_path):
    rows = [("L", f"2024-01-0{1 + i} 00:00:00", i, 19723.0 + i, [1, 2], [3, 4] if i % 2 else [3], i % 3, 1, False, i == 3) for i in range(6)]
    df = spark.createDataFrame(rows, "league string, t string, game_id long, day double, r1 array<long>, r2 array<long>, s1 int, s2 int, outcome_only boolean, tournament boolean").selectExpr("league", "CAST(t AS timestamp) AS ts", "game_id", "day", "r1", "r2", "s1", "s2", "outcome_only", "tournament")
    src = str(tmp_path / "in")
    for i in range(0, 6, 2):  # two games a file
        df.where(f"game_id in ({i}, {i + 1})").coalesce(1).write.mode("append").parquet(src)
    last = df.where("game_id = 5").selectExpr("league", "ts + INTERVAL 30 DAYS AS ts", "99L AS game_id", "day + 30 AS day", "r1", "r2", "s1", "s2", "outcome_only", "tournament")
    last.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = online_elo(stream).writeStream.format("memory").queryName("elo_out").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.game_id: r.p for r in spark.table("elo_out").collect()}
    want = {r.game_id: r.p for r in catalyst_elo(df).collect()}
    assert set(got) >= set(range(5))
    assert all(abs(got[i] - want[i]) < 1e-9 for i in got if i != 99)
