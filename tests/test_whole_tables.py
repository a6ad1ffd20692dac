"""Queries that do the whole job, on the small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from laddersmith import catalog, fixtures
from laddersmith.operators import aliases, folds, joins
from laddersmith.plans import history
from laddersmith.plans.registry import make

SF = "/root/testdata/sf0.001"


def test_queries_read_every_order(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    assert fixtures.games(spark, SF).count() == orders.count() == 1500
    li = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_returnflag in ('A', 'R')").groupBy("l_orderkey").agg(F.sum(F.expr("CASE l_returnflag WHEN 'A' THEN 1 ELSE -1 END")).alias("d"))
    decided = orders.join(li, F.col("o_orderkey") == F.col("l_orderkey")).where("d <> 0").count()
    assert catalog.queries()["trueskill_chrono_metrics"](spark, SF).head().n == decided


@pytest.mark.parametrize("model", ["bt_mov", "bt_mov_time_decay", "bt_vet", "bt_uncert", "bt_normal"])
def test_batch_histories_fit_every_prefix(spark, model):
    g = catalog._full(spark, SF).cache()
    got = {(r.ts, r.player): r.rating for r in history.run_model(g, model).collect()}
    m, want = None, {}
    for n, x in enumerate(games := folds.as_games(g.toPandas()), 1):
        if n not in (10, 333, 760, len(games)) and not (n < 1200 and n % 397 == 0):  # fits from nothing, in several stretches
            continue
        if n < len(games) and games[n].day == x.day:
            continue  # of games at one time the last counts
        m = make(model)
        names = {r.game_id: (r.team1, r.team2) for r in g.select("game_id", "team1", "team2").collect()}
        for y in games[:n]:
            m.update(y, names[y.game_id]) if model == "bt_uncert" else m.update(y)
        m.converge()
        ts = {r.game_id: r.ts for r in g.select("game_id", "ts").collect()}[x.game_id]
        own = {p for p in (*x.r1, *x.r2)}
        want |= {(ts, p): m.expose(p) for p in own}
    assert want and len({ts for ts, _ in got}) > 1
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-3), k


def test_batch_back_test_fits_before_every_game(spark):
    terms = []
    m = make("bt_mov")
    for x in folds.as_games(catalog._full(spark, SF).toPandas()):
        p = min(max(m.predict(x), 1e-12), 1 - 1e-12)
        if x.s1 != x.s2:
            terms.append(-math.log(p if x.s1 > x.s2 else 1 - p))
        m.update(x)
    got = catalog.queries()["bt_mov_chrono_metrics"](spark, SF).head()
    assert got.n == len(terms) and got.nll == pytest.approx(sum(terms) / len(terms), abs=1e-6)


def test_wide_history_fills_every_cell(spark):
    h = history.sequential_history(catalog._full(spark, SF), "elo").cache()
    players = fixtures.rosters(spark, SF).select("player").distinct().count()
    rows = catalog.queries()["wide_rating_history"](spark, SF).collect()
    assert len(rows) == h.select("ts").distinct().count() + 1  # the first row of every player
    assert all(len(r.ratings.split(",")) == players and "" not in r.ratings.split(",") for r in rows)


def test_no_grid_of_players_and_times(spark, capsys):
    """Neither a nested loop nor a product, but for frames of one row."""
    for name in ("wide_rating_history", "team_histories"):
        catalog.queries()[name](spark, SF).explain()
        plan = capsys.readouterr().out
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_alias_blocking_loses_no_pair(spark):
    names = ["katherine", "catherine", "ann", "joanna", "bo", "jim bo lee", "maria lopez", "mario lopes", "x", "alexander smith", "aleksander smith", "zoe"]
    n = spark.createDataFrame([(x, 1) for x in names], "name string, n long")
    got = {(r.a, r.b) for r in aliases.candidates(n).collect()}
    assert {("catherine", "katherine"), ("ann", "joanna")} <= got
    assert got == {(r.a, r.b) for r in aliases.candidates(n, blocked=False).collect()}


def test_alias_index_equals_all_pairs_on_generated_names(spark, capsys):
    """Typed names with letters dropped, doubled, swapped and added, initials, short names and names inside others."""
    rng = random.Random(11)
    first = "al bo ann anna joan joanna maria mario katherine catherine alexander aleksander jim".split()
    last = "li lee lopez lopes smith smyth o'neill hill van der berg kowalski kowalsky garcia".split()
    names = {"x", "xy", "a b", "É", "jo-ann"}
    while len(names) < 650:
        w = list(rng.choice(first) + rng.choice(["", " ", " j "]) + rng.choice(last) + rng.choice(["", "", str(rng.randrange(30))]))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[], [w[i], w[i]], [rng.choice("aeiourst ")], [w[i], rng.choice("aeiourst")]])
            w = w or ["q"]
        names.add("".join(w))
    n = spark.createDataFrame([(x, 1 + i % 3) for i, x in enumerate(sorted(names))], "name string, n long")
    found = aliases.candidates(n)
    got = {tuple(r) for r in found.collect()}
    want = {tuple(r) for r in aliases.candidates(n, blocked=False).collect()}
    assert len(want) > 1500 and got == want
    found.explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_prefixes_against_brute_force(spark, capsys):
    rng = random.Random(12)
    games = [(g, rng.randrange(40) if g % 9 else None, rng.randrange(5)) for g in range(300)]
    cps = [(i, t) for i, t in enumerate([0, 1, 7, 7, 22, 39, 40, 99])]
    g = spark.createDataFrame(games, "game_id long, s long, v long").withColumn("ts", F.timestamp_seconds("s"))
    c = spark.createDataFrame(cps, "cp long, s long").select("cp", F.timestamp_seconds("s").alias("cp_ts"))
    out = joins.training_prefix(c, g, F.col("v").alias("points"))
    got = {r.cp: (r.train_games, r.points) for r in out.collect()}
    assert got == {i: (sum(s is not None and s < t for _, s, _ in games), sum(v for _, s, v in games if s is not None and s < t)) for i, t in cps}
    out.explain()
    assert "NestedLoop" not in capsys.readouterr().out


def test_canonical_names_take_the_reference_threshold(spark, tmp_path):
    spark.createDataFrame([(1, "jo"), (2, "joanna hill"), (3, "zz")], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r.name: r.canonical for r in catalog.queries()["alias_canonical"](spark, str(tmp_path)).collect()}
    assert got["team jo"] == got["team joanna hill"]
