"""Alias candidates, their components, and the canonical names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laddersmith.functions.names import alias_key, last_name, similarity
from laddersmith.operators.graph import components
from laddersmith.session import materialize


#: Names are similar above this ratio of matched letters; then fewer than 15 % of both lengths together are unmatched.
SIMILAR, APART = 0.85, 15
#: Letters of a piece by which longer names are found inside others.
PIECE = 4


def candidates(counts: DataFrame, threshold: float = 0.72, blocked: bool = True) -> DataFrame:
    """Pairs of names that may be one player: (a < b, score), with their counts.

    Equal keys score 1; equal last names 0.7 + 0.3 * similarity of the rest; else a similarity above 0.85, or 0.8 if one contains the other.
    ``blocked`` measures only pairs that can score, found by equal values: keys, last names, segments of near names, pieces of contained ones. None is lost
    by that. Without it every pair is measured.
    """
    n = _keyed(counts)
    if blocked:
        n = materialize(n, "aliases")
        return _scored(_found(n), n, threshold)
    return _scored(n.select(F.col("name").alias("name_a")).join(n.select(F.col("name").alias("name_b")), F.col("name_a") < F.col("name_b")), n, threshold)


def linking(counts: DataFrame, threshold: float = 0.72) -> DataFrame:
    """(a, b): of the pairs that candidates() finds, as many as leave its components as they are.

    Equal keys and names that contain others come first, whose pairs are few; further pairs are only looked for, and measured, between what those have not connected. Groups of equal
    values within one component are dropped before they are joined.
    """
    n = materialize(_keyed(counts), "aliases")
    first = n.groupBy("key").agg(F.min("name").alias("a"))
    sure = n.join(first, "key").where("name <> a").select("a", F.col("name").alias("b"))
    last = lambda s: n.select(F.col("name").alias(f"name_{s}"), F.col("last").alias(f"last_{s}"))
    held = materialize(_contained(n), "aliases-held")
    if threshold < 0.8:  # names that contain others score 0.8 or more, but those of one last name
        apart = held.join(last("a"), "name_a").join(last("b"), "name_b").where("last_a <> last_b")
        sure = sure.unionByName(apart.select(F.col("name_a").alias("a"), F.col("name_b").alias("b")))
    sure = materialize(sure.where(F.lit(threshold < 1)), "aliases-sure")
    label = components(sure, "aliases").select(F.col("node").alias("name"), "label")
    n = materialize(n.join(label, "name", "left").withColumn("label", F.coalesce("label", "name")), "aliases")
    mark = lambda s: n.select(F.col("name").alias(f"name_{s}"), F.col("label").alias(f"label_{s}"))
    rest = _same(n, "last").unionByName(_near(n)).unionByName(held).distinct().join(mark("a"), "name_a").join(mark("b"), "name_b").where("label_a <> label_b")
    return sure.unionByName(_scored(rest.select("name_a", "name_b"), n, threshold).select("a", "b"))


def _keyed(counts: DataFrame) -> DataFrame:
    n = counts.select("name", "n", alias_key("name").alias("key")).where("key <> ''").withColumn("last", last_name(F.col("name")))
    tokens = F.split("key", " ")
    return n.withColumn("first", F.array_join(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(1))), " "))


def _scored(pairs: DataFrame, n: DataFrame, threshold: float) -> DataFrame:
    """The pairs (name_a, name_b) that score above the threshold."""
    side = lambda s: n.select(*[F.col(c).alias(f"{c}_{s}") for c in n.columns])
    inside = F.col("key_a").contains(F.col("key_b")) | F.col("key_b").contains(F.col("key_a"))
    pairs = pairs.join(side("a"), "name_a").join(side("b"), "name_b")
    whole, part = similarity("key_a", "key_b"), similarity("first_a", "first_b")
    pairs = pairs.withColumn("_w", whole).withColumn("_p", part)
    score = F.when(F.col("key_a") == F.col("key_b"), 1.0).when(F.col("last_a") == F.col("last_b"), 0.7 + 0.3 * F.col("_p")).when(F.col("_w") > SIMILAR, F.col("_w")).when(inside, 0.8).otherwise(0.0)
    out = pairs.withColumn("score", score).where(F.col("score") > threshold)
    return out.select(F.col("name_a").alias("a"), F.col("name_b").alias("b"), "score", F.col("n_a").alias("n_a"), F.col("n_b").alias("n_b"))


def _found(n: DataFrame) -> DataFrame:
    """(name_a < name_b): the pairs that can score, each once."""
    return _same(n, "key").unionByName(_same(n, "last")).unionByName(_near(n)).unionByName(_contained(n)).distinct()


def _same(n: DataFrame, c: str) -> DataFrame:
    label = ["label"] if "label" in n.columns else []
    return _pairs(n.select(c, F.col("name").alias("x"), *label), n.select(c, F.col("name").alias("y"), *label), [c])


def _pairs(x: DataFrame, y: DataFrame, on: list[str], check=None) -> DataFrame:
    """Pairs of equal values ``on``; if both sides have a ``label``, only those of different ones."""
    if "label" in x.columns and "label" in y.columns:
        mixed = x.select(*on, "label").unionByName(y.select(*on, "label")).groupBy(*on).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(*on)
        x = x.join(mixed, on, "left_semi").withColumnRenamed("label", "label_x")
        y = y.join(mixed, on, "left_semi").withColumnRenamed("label", "label_y")
        both = x.join(y, on).where("label_x <> label_y")
    else:
        both = x.join(y, on).where("x <> y")
    both = both if check is None else both.where(check)
    return both.select(F.least("x", "y").alias("name_a"), F.greatest("x", "y").alias("name_b"))


def _near(n: DataFrame) -> DataFrame:
    """Pairs that similarity can find near: the shorter one is cut into one segment more than letters may be unmatched, so one segment stands whole in the longer one.

    Segments are found by both lengths, their number and their text, at the places that the unmatched letters before them allow."""
    label = ["label"] if "label" in n.columns else []
    own = n.select("name", "key", F.length("key").alias("own"), *label)
    most = F.expr(f"({APART} * (l + m) - 1) div 100").alias("d")  # letters that may be unmatched in both together
    cut = "i * l div (d + 1)"
    short = own.select("name", "key", *label, F.col("own").alias("l"), F.explode(F.expr(f"sequence(own, ({100 + APART} * own - 1) div {100 - APART})")).alias("m")).select("*", most).where("d > 0")
    short = short.select("*", F.explode(F.expr("sequence(0, d)")).alias("i"))
    short = short.select(F.col("name").alias("x"), F.col("key").alias("key_x"), *label, "l", "m", "i", F.expr(f"substring(key, cast({cut} + 1 as int), cast((i + 1) * l div (d + 1) - {cut} as int))").alias("text"))
    wide = own.select("name", "key", *label, F.col("own").alias("m"), F.explode(F.expr(f"sequence(({100 - APART} * own) div {100 + APART} + 1, own)")).alias("l")).select("*", most).where("d > 0")
    wide = wide.select("*", F.explode(F.expr("sequence(0, d)")).alias("i")).select("*", F.expr(cut).alias("at"), F.expr(f"(i + 1) * l div (d + 1) - {cut}").alias("size"))
    # letters left out before a segment move it back, letters put in move it on
    wide = wide.select("*", F.expr("greatest(0, at - (d - (m - l)) div 2)").alias("from"), F.expr("least(m - size, at + (d + (m - l)) div 2)").alias("to")).where("`from` <= `to`")
    wide = wide.select(F.col("name").alias("y"), F.col("key").alias("key_y"), *label, "l", "m", "i", F.explode(F.expr("array_distinct(transform(sequence(`from`, `to`), p -> substring(key, cast(p + 1 as int), cast(size as int))))")).alias("text"))
    return _pairs(short, wide, ["l", "m", "i", "text"], F.expr(f"100 * levenshtein(key_x, key_y) < {APART} * (l + m)"))


def _contained(n: DataFrame) -> DataFrame:
    """Pairs of which one contains the other: names below PIECE letters are found whole, longer ones by their rarest piece."""
    pieces = lambda size: f"transform(sequence(1, length(key) - {size - 1}), p -> substring(key, p, {size}))"
    every = F.expr("array_distinct(flatten(array(" + ", ".join(f"CASE WHEN length(key) >= {k} THEN {pieces(k)} ELSE array() END" for k in range(1, PIECE + 1)) + ")))")
    held = materialize(n.select(F.col("name").alias("x"), F.col("key").alias("key_x"), F.explode(every).alias("piece")), "aliases-pieces")
    often = held.where(F.length("piece") == PIECE).groupBy("piece").agg(F.count(F.lit(1)).alias("often"))
    long = held.where((F.length("key_x") >= PIECE) & (F.length("piece") == PIECE)).join(often, "piece").groupBy("x").agg(F.min_by("piece", F.struct("often", "piece")).alias("piece"), F.first("key_x").alias("key_y"))
    asks = long.select(F.col("x").alias("y"), "key_y", "piece").unionByName(n.where(F.length("key") < PIECE).select(F.col("name").alias("y"), F.col("key").alias("key_y"), F.col("key").alias("piece")))
    return _pairs(held, asks, ["piece"], F.col("key_x").contains(F.col("key_y")))


def ranked(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy(F.desc("score"), F.desc(F.col("n_a") + F.col("n_b")), "a", "b")


def canonical(counts: DataFrame, pairs: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(name, canonical) of names in a component: the most frequent, then the first by name; ``overrides`` (name, canonical) win."""
    comp = components(pairs.select("a", "b"), "aliases")
    named = comp.join(counts.select(F.col("name").alias("node"), "n"), "node", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("label").orderBy(F.desc("n"), "node")
    out = named.select(F.col("node").alias("name"), F.first("node").over(w).alias("canonical"))
    if overrides is not None:
        o = overrides.select("name", F.col("canonical").alias("_o"))
        out = out.join(o, "name", "left").select("name", F.coalesce("_o", "canonical").alias("canonical"))
    return out
