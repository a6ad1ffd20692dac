"""Hard-negative mining (operator 12).

Anchors meet all rows in cells: a stripe of at most ``STRIPE`` anchors and a share of at most about ``ROWS`` rows,
both of bounded size, dealt by a number of their own so that no label, vector or id can fill a cell. In a cell every anchor's
integer scores are sorted whole, by score and id. A first pass reads each anchor's best rows of its own label;
merged over the shares they are its positives. A second pass reads, for each positive, the rows of other labels from its upper limit (found by binary
search) down to its lower one. The best ``k`` of each share hold the best ``k`` of all, so merging is exact.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; neither do rows with a null id.
Vectors of different lengths are padded with zeros, an empty one scores 0 with all. Rows that repeat are rows: each is an anchor of its own (so its result repeats) and
a positive or negative of others. Components beyond 63 bits and scores beyond them are held at the ends of that range. An anchor without positives,
or a positive without negatives between its limits, returns nothing. Extra columns take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laddersmith.llm.common import by_group, materialize, read, ship

#: Anchors of a stripe and rows of a share, about; scores that are held at a time; tasks, among which cells are dealt.
STRIPE, ROWS, HELD, TASKS = 2048, 16_384, 1 << 22, 20_000
_TOP = np.iinfo(np.int64).max


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of one width."""
    v = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    size = np.diff(v.offsets.to_numpy())
    flat = v.values.to_numpy(zero_copy_only=False)[v.offsets[0].as_py() : v.offsets[-1].as_py()]
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of two matrices, held within 63 bits."""
    bound = a.shape[1] * float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0))
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -_TOP, _TOP).astype(np.int64)


def _ranking(scores: np.ndarray) -> np.ndarray:
    """Places of a row of scores, the highest first; those that tie stay in their order (by id)."""
    low = scores.min(initial=0)
    if int(scores.max(initial=0)) - int(low) < 1 << 40:  # one key of score and place sorts faster than two
        bits = int(max(1, len(scores) - 1)).bit_length()
        return np.sort(((scores.max(initial=0) - scores) << bits) | np.arange(len(scores))) & ((1 << bits) - 1)
    return np.lexsort((np.arange(len(scores)), -scores))


def _limits(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest negative score: low * positive <= 100 * negative <= high * positive."""
    return -(-low * score // 100), high * score // 100


class _Cell:
    """The anchors and rows of a cell; rows stand by id."""

    def __init__(self, table: pa.Table):
        kind = table.column("kind").to_numpy()
        cut = int((kind == 0).sum())
        self.anchors, self.rows = table.slice(0, cut), table.slice(cut)
        self.a, self.b = [{c: t.column(c).to_numpy() for c in ("num", "id", "tag")} for t in (self.anchors, self.rows)]
        self.width = max([int(pc.max(pc.list_value_length(t.column("vec"))).as_py() or 0) for t in (self.anchors, self.rows) if t.num_rows], default=0)

    def each(self):
        """(place of an anchor, its scores with all rows)"""
        if not self.anchors.num_rows or not self.rows.num_rows:
            return
        b = _matrix(self.rows.column("vec"), self.width)
        step = max(1, HELD // len(b))
        for s in range(0, self.anchors.num_rows, step):
            part = _scores(_matrix(self.anchors.slice(s, step).column("vec"), self.width), b)
            for i in range(len(part)):
                yield s + i, part[i]


def _best_positives(k: int):
    def run(_, table):
        c = _Cell(table)
        num, pid, score = [], [], []
        by_tag = {t: np.flatnonzero(c.b["tag"] == t) for t in np.unique(c.a["tag"])}
        for i, s in c.each():
            same = by_tag[c.a["tag"][i]]
            same = same[c.b["num"][same] != c.a["num"][i]]
            top = same[_ranking(s[same])[:k]]
            num += [c.a["num"][i]] * len(top)
            pid += c.b["id"][top].tolist()
            score += s[top].tolist()
        return pa.table({"num": pa.array(num, pa.int64()), "positive_id": pa.array(pid, pa.int64()), "positive_score": pa.array(score, pa.int64())})

    return run


def _best_negatives(k: int, low: int, high: int):
    def run(_, table):
        c = _Cell(table)
        wanted = c.anchors.column("positives").to_pylist()
        num, nth, nid, score = [], [], [], []
        other = {t: np.flatnonzero(c.b["tag"] != t) for t in np.unique(c.a["tag"])}
        for i, s in c.each():
            rest = other[c.a["tag"][i]]
            rest = rest[_ranking(s[rest])]
            falling = -s[rest]
            for j, p in enumerate(wanted[i]):
                least, most = _limits(p["positive_score"], low, high)
                at = int(np.searchsorted(falling, -most))
                take = rest[at : at + k]
                take = take[s[take] >= least]
                num += [c.a["num"][i]] * len(take)
                nth += [j] * len(take)
                nid += c.b["id"][take].tolist()
                score += s[take].tolist()
        return pa.table({"num": pa.array(num, pa.int64()), "nth": pa.array(nth, pa.int32()), "negative_id": pa.array(nid, pa.int64()), "negative_score": pa.array(score, pa.int64())})

    return run


def _cells(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int) -> tuple[DataFrame, int]:
    """Every stripe of anchors beside every share of rows."""
    stripes, shares = max(1, -(-n_anchors // STRIPE)), max(rows.sparkSession.sparkContext.defaultParallelism, -(-n_rows // ROWS))
    dealt = lambda n: F.pmod(F.xxhash64("num"), F.lit(n))
    one = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = anchors.withColumn("stripe", dealt(stripes)).withColumn("share", one(shares)).withColumn("kind", F.lit(0))
    b = rows.withColumn("share", dealt(shares)).withColumn("stripe", one(stripes)).withColumn("kind", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn("cell", F.col("stripe").cast("long") * shares + F.col("share")).drop("stripe", "share"), stripes * shares


def _first(df: DataFrame, by: list[str], score: str, ident: str, k: int, rank: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), ident)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def mine(rows: DataFrame, anchors: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``rows`` (id, tag, vec of integers) to (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` says of a row whether it is one. A positive's negatives score between ``low`` and ``high`` hundredths of its own score."""
    ship(rows.sparkSession)
    rows = rows.select(F.monotonically_increasing_id().alias("at"), F.col("id").cast("long"), F.col("tag").cast("long"), "vec", F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    rows = materialize(rows, "negatives-rows")
    counts = rows.agg(F.count("*"), F.count(F.when(F.col("is_anchor"), 1))).first()
    rows = rows.withColumnRenamed("at", "num")
    anchor_rows = rows.where("is_anchor").drop("is_anchor")
    everything = rows.drop("is_anchor")
    cells, n = _cells(anchor_rows, everything, counts[1], counts[0])
    found = by_group(cells, "cell", _best_positives(positives), "num long, positive_id long, positive_score long", ["kind", "id"], parts=min(n, TASKS), task=(F.col("cell") % min(n, TASKS)).cast("int"))
    best = _first(found, ["num"], "positive_score", "positive_id", positives, "nth")
    lists = best.groupBy("num").agg(F.array_sort(F.collect_list(F.struct("nth", "positive_id", "positive_score"))).alias("positives"))
    lists = materialize(anchor_rows.join(lists, "num"), "negatives-positives")
    cells, n = _cells(lists, everything, counts[1], counts[0])
    found = by_group(cells, "cell", _best_negatives(k, low, high), "num long, nth int, negative_id long, negative_score long", ["kind", "id"], parts=min(n, TASKS), task=(F.col("cell") % min(n, TASKS)).cast("int"))
    ranked = _first(found, ["num", "nth"], "negative_score", "negative_id", k, "rank")
    named = lists.select("num", F.col("id").alias("anchor_id"), F.posexplode("positives").alias("nth", "p")).select("num", "nth", "anchor_id", "p.positive_id", "p.positive_score")
    return ranked.join(named, ["num", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def quantized(embeddings: DataFrame, label: Column) -> DataFrame:
    """``embeddings`` (vec_id, embedding) to (id, tag, vec): rows that take part, components as floor(256 * x)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return good.select(F.col("vec_id").alias("id"), label.alias("tag"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vec"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row of ``embeddings`` whose id is divisible by 100, among all rows."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(quantized(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), label), F.col("id") % 100 == 0)


SQL = """WITH rows_ AS MATERIALIZED (SELECT row_number() OVER () AS num, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS tag, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (SELECT a.num, a.id AS anchor_id, a.tag = b.tag AS same, b.id, CAST(list_inner_product(a.vec, b.vec) AS BIGINT) AS score FROM rows_ a JOIN rows_ b ON a.id % 100 = 0 AND a.num <> b.num),
positives AS (SELECT num, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY num ORDER BY score DESC, id) AS nth FROM scored WHERE same QUALIFY nth <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.num, nth ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.num = p.num AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""
