"""Connected components over edge DataFrames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laddersmith.session import discard, materialize, ship

#: Edges that a task holds at once.
HELD = 200_000


def _state(df: DataFrame) -> tuple:
    r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
    return (r[0], r[1])


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, label) of an undirected graph given as rows (a, b): label is the least node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges stand
    still. Each step aggregates with map-side combining and joins the minimum back, so that
    a hub's neighbours never meet in one task unsplit; each step's edges are written to the shared folder.
    """
    now = materialize(edges.select("a", "b").where("a <> b").distinct(), name)
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low2 = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low2.select("a", F.col("m").alias("b")))
        nxt = materialize(small.where("a <> b").distinct(), name)
        new = _state(nxt)
        discard(now)
        now, same = nxt, new == state
        state = new
        if same:
            break
    return now.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _stars(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components: those of each partition that are connected as stars around their least node, HELD edges at a time."""
    ship(edges.sparkSession)
    kind = dict(edges.dtypes)["a"]

    def run(batches):
        up, n = {}, 0

        def top(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def told():
            rows = [(x, top(x)) for x in list(up)]
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + 10_000]], schema.field(k).type) for k in (0, 1)], names=["a", "b"])
            up.clear()

        for batch in batches:
            schema = batch.schema
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(a), top(b)
                up[max(a, b)] = min(a, b)
            n += batch.num_rows
            if n >= HELD:
                n = 0
                yield from told()
        if up:
            yield from told()

    return edges.select("a", "b").distinct().mapInArrow(run, f"a {kind}, b {kind}")


def player_leagues(games: DataFrame) -> DataFrame:
    """(game_id, league): games of different leagues share no player, not even through others.

    ``games`` has r1 and r2. Games without players are leagues of their own. The graph has the distinct rosters' players and the
    distinct pairs of rosters that met, not every game's.
    """
    first = F.coalesce(F.get("r1", F.lit(0)), F.get("r2", F.lit(0)))
    rosters = games.select(F.explode(F.array("r1", "r2")).alias("r")).where(F.size("r") > 0).distinct()
    edges = rosters.select(F.col("r")[0].alias("a"), F.explode("r").alias("b"))
    met = games.where((F.size("r1") > 0) & (F.size("r2") > 0)).select(F.col("r1")[0].alias("a"), F.col("r2")[0].alias("b")).distinct()
    lab = components(edges.unionByName(met), "leagues")
    g = games.select("game_id", first.alias("node")).where("node is not null")
    return g.join(lab, "node", "left").select("game_id", F.coalesce("label", "node").alias("league"))


def side_leagues(sides: DataFrame, met: DataFrame) -> DataFrame:
    """(side, league) of sides (side, r) with players, of which those of ``met`` (h1, h2) played each other; leagues as in player_leagues()."""
    first = sides.select("side", F.col("r")[0].alias("a"))
    edges = sides.select(F.col("r")[0].alias("a"), F.explode("r").alias("b"))
    met = met.where("h1 is not null and h2 is not null and h1 <> h2").distinct().join(first.withColumnRenamed("side", "h1"), "h1").join(first.select(F.col("side").alias("h2"), F.col("a").alias("b")), "h2").select("a", "b")
    lab = components(_stars(edges.unionByName(met)), "leagues")
    return first.join(lab, F.col("a") == F.col("node"), "left").select("side", F.coalesce("label", "a").alias("league"))
