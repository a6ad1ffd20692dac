"""Toxic passages by maximum-scoring segments (operator 1).

Tokens score by their log-odds between toxic and other training texts. A word's odds have a
Dirichlet prior that its 6-byte beginning gives, which has one from its 4-byte beginning,
which has the corpus. A linear-time scan (Ruzzo and Tompa, 1999) finds every maximal segment. Segments
are judged by extreme-value statistics (Karlin and Altschul, 1990): a segment of score S in m
tokens has E = K * m * exp(-lambda * S). A document's evidence is the sum of -ln E over
its significant segments, and a logistic curve turns it into a probability.

The model is fitted on at most SAMPLE labelled documents (drawn by a hash of the id). A feature counts if it makes up SHARE of
the sample's tokens, so there are at most 1 / SHARE features a level and what is broadcast has a fixed bound. Every document is scored whole.

Defined results: null or empty texts have no segment and get the curve's value at no evidence;
without training rows of both classes every score is the share of toxic ones (0 if none);
several labels of one document count as toxic if one is; rows without label or id are scored
but not learned from; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laddersmith.llm import words as W
from laddersmith.llm.common import fold, read

#: Labelled documents that the fit reads at most; the least share of their tokens (and the least number) that makes a feature.
SAMPLE = 60_000
SHARE, LEAST = 1e-6, 4
PREFIXES = (4, 6)
PRIOR = 10.0
#: What each token costs; a token must beat it to start a segment.
DRIFT = 2.0
#: Segments with E above this are no evidence.
MAX_E = 0.05
THRESHOLD = 0.7
U = np.uint64
BINS = np.linspace(-DRIFT - 8, 10, 361)


@dataclass
class Model:
    keys: np.ndarray
    odds: np.ndarray
    lam: float = 1.0
    log_k: float = 0.0
    intercept: float = 0.0
    slope: float = 0.0

    def __post_init__(self):
        self.maybe = None


def _features(col: pa.Array):
    """By runs of rows: (first row, rows' first words, one array of hashes for each level, from short to whole)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    for i, _, buf, offs in W.chunks(pc.utf8_lower(col)):
        s, e, first = W.word_spans(buf, offs, W.NOT_ALNUM)
        yield i, first, [W.span_hashes(buf, s, np.minimum(e, s + n)) for n in PREFIXES] + [W.span_hashes(buf, s, e)]


def token_scores(m: Model, levels: list[np.ndarray]) -> np.ndarray:
    """Log-odds of each token, from the longest of its features that the model has, less DRIFT."""
    out = np.full(len(levels[0]), -DRIFT)
    if not len(m.keys):
        return out
    if m.maybe is None:
        m.maybe = np.zeros(1 << 20, bool)
        m.maybe[(m.keys & U((1 << 20) - 1)).astype(np.int64)] = True
    for h in levels:  # longer features overwrite shorter ones
        i = np.flatnonzero(m.maybe[(h & U((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(m.keys, h[i]), len(m.keys) - 1)
        ok = m.keys[at] == h[i]
        out[i[ok]] = m.odds[at[ok]] - DRIFT
    return out


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, end, score) of every maximal scoring segment, in order; linear in the number of scores."""
    pos = np.flatnonzero(scores > 0)
    if not len(pos):
        return []
    cum = np.concatenate([[0.0], np.cumsum(scores)])
    left, right = cum[pos].tolist(), cum[pos + 1].tolist()
    found: list[list] = []  # [first, end, sum before, sum after, the last before it with a smaller sum before]
    for p, lo, hi in zip(pos.tolist(), left, right, strict=True):
        first, end = p, p + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= lo:
                j = found[j][4]
            if j < 0 or found[j][3] >= hi:
                found.append([first, end, lo, hi, j])
                break
            first, lo = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, hi - lo) for a, b, lo, hi, _ in found]


def _training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the bounded sample of the labelled rows outside the held-out fold."""
    lab = labels.select(F.col("doc_id").alias("_id"), F.col("toxic")).where("_id is not null and toxic is not null")
    lab = lab.where(fold("_id", 3) != 1).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, SAMPLE / max(1, lab.count()))
    if share < 1:
        lab = lab.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    docs = docs.select(F.col("doc_id").alias("_doc"), F.col("text").cast("string").alias("text"))  # other columns' names can't clash
    return docs.join(F.broadcast(lab), F.col("_doc") == F.col("_id")).select("text", "toxic")


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    train = _training(docs, labels)

    def count(batches):
        for b in batches:
            y = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, first, levels in _features(b.column(0)):
                tox = np.repeat(y[i : i + len(first) - 1], np.diff(first)) > 0
                for n, h in enumerate(levels):
                    parent = levels[n - 1] if n else np.zeros(len(h), U)
                    own = h != parent
                    k, at, inv = np.unique(h[own], return_index=True, return_inverse=True)
                    y1 = np.bincount(inv, tox[own], len(k)).astype(np.int64)
                    y0 = np.bincount(inv, minlength=len(k)) - y1
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(parent[own][at].view(np.int64)), pa.array(np.full(len(k), n)), pa.array(y1), pa.array(y0)], names=["f", "parent", "level", "y1", "y0"])

    counts = train.mapInArrow(count, "f long, parent long, level long, y1 long, y0 long")
    counts = counts.groupBy("f", "parent", "level").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")).persist()
    tot = counts.where("level = 0").agg(F.sum("y1"), F.sum("y0")).head()
    n1, n0 = tot[0] or 0, tot[1] or 0
    if not n1 or not n0:
        counts.unpersist()
        c = train.agg(F.count(F.lit(1)), F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0))).head()
        share = (c[1] or 0) / c[0] if c[0] else 0.0
        return Model(np.zeros(0, U), np.zeros(0), intercept=_logit(min(max(share, 1e-9), 1 - 1e-9)))
    # the z-score of the log-odds under the prior (Monroe, Colaresi and Quinn, 2008)
    p0 = n1 / (n1 + n0)
    a, b = F.col("y1") + PRIOR * p0, F.col("y0") + PRIOR * (1 - p0)
    z = F.abs((F.log(a / b) - _logit(p0)) / F.sqrt(1 / a + 1 / b))
    least = max(LEAST, math.ceil(SHARE * (n1 + n0)))
    top = counts.where(F.col("y1") + F.col("y0") >= least).withColumn("z", z).where("z >= 2").select("level", "f", "parent", "y1", "y0").toArrow()
    counts.unpersist()
    level, f, parent, y1, y0 = (top.column(i).to_numpy() for i in range(5))
    keys, odds = np.zeros(0, np.int64), np.zeros(0)
    for n in range(len(PREFIXES) + 1):  # a parent is of a level before
        own = level == n
        at = np.minimum(np.searchsorted(keys, parent[own]), max(len(keys) - 1, 0))
        up = np.where(keys[at] == parent[own], odds[at], 0.0) if len(keys) else np.zeros(own.sum())
        prior = 1 / (1 + np.exp(-(up + _logit(p0))))
        share = (y1[own] + PRIOR * prior) / (y1[own] + y0[own] + PRIOR)
        keys, odds = np.concatenate([keys, f[own]]), np.concatenate([odds, np.log(share / (1 - share)) - _logit(p0)])
        o = np.argsort(keys, kind="stable")
        keys, odds = keys[o], odds[o]
    keys = keys.view(U)
    o = np.argsort(keys)
    m = Model(keys[o], odds[o])

    def judge(batches):
        for b in batches:
            y = b.column(1).to_numpy(zero_copy_only=False)
            size, hist = np.zeros(len(y), np.int64), np.zeros(len(BINS) - 1, np.int64)
            doc, seg = [], []
            for i, first, levels in _features(b.column(0)):
                x = token_scores(m, levels)
                for r in range(len(first) - 1):
                    own = x[first[r] : first[r + 1]]
                    size[i + r] = len(own)
                    got = maximal_segments(own)
                    doc += [i + r] * len(got)
                    seg += [g[2] for g in got]
                    if not y[i + r]:
                        hist += np.histogram(np.clip(own, BINS[0], BINS[-1]), BINS)[0]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((y.tolist(), pa.list_(pa.int64())), (size.tolist(), pa.list_(pa.int64())), (doc, pa.list_(pa.int64())), (seg, pa.list_(pa.float64())), (hist.tolist(), pa.list_(pa.int64())))], names=["y", "size", "doc", "seg", "hist"])

    rows = train.select("text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(judge, "y array<long>, size array<long>, doc array<long>, seg array<double>, hist array<long>").collect()
    y, size = np.concatenate([np.array(r.y) for r in rows]) > 0, np.concatenate([np.array(r["size"]) for r in rows])
    off = np.cumsum([0, *(len(r.y) for r in rows)])
    doc = np.concatenate([np.array(r.doc, np.int64) + off[i] for i, r in enumerate(rows)])
    seg = np.concatenate([np.array(r.seg, float) for r in rows])
    p = np.sum([r.hist for r in rows], axis=0).astype(float)
    mid = (BINS[1:] + BINS[:-1]) / 2
    m.lam = _lambda(mid, (p + 1e-9) / (p + 1e-9).sum())
    best = np.zeros(len(y))
    np.maximum.at(best, doc, seg)
    bg = ~y & (size > 0)
    m.log_k = -math.log(max(1e-300, float(np.mean(size[bg] * np.exp(-m.lam * best[bg]))))) if bg.any() else 0.0
    ev = evidence(m, size, doc, seg)
    m.intercept, m.slope = _logistic(ev, y.astype(float))
    return m


def _lambda(x: np.ndarray, p: np.ndarray) -> float:
    """The positive root of sum p * exp(lambda * x) = 1."""
    if not ((p > 0) & (x > 0)).any() or (p * x).sum() >= 0:
        return 1.0
    lo, hi = 0.0, 1.0
    while (p * np.exp(hi * x)).sum() < 1 and hi < 50:
        lo, hi = hi, 2 * hi
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(mid * x)).sum() < 1 else (lo, mid)
    return max(lo, 1e-3)


def evidence(m: Model, size: np.ndarray, doc: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Sum of -ln E over the significant segments of each document."""
    out = np.zeros(len(size))
    if len(seg):
        e = m.lam * seg - m.log_k - np.log(np.maximum(size[doc], 1))
        np.add.at(out, doc, np.where(e >= -math.log(MAX_E), e, 0.0))
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (0 or more) by Newton steps with a weak ridge on the slope."""
    a, b = 0.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -35, 35)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([(y - p).sum() - 1e-3 * a, ((y - p) * x).sum() - 0.1 * b])
        h = np.array([[w.sum() + 1e-3, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.1]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(max(b, 0.0))


def score(docs: DataFrame, m: Model) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, score, n_segments, top_start, top_end): the segment places count words from 0."""

    def run(batches):
        for b in batches:
            n = b.num_rows
            size, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
            best = np.full((n, 2), -1, np.int64)
            doc, seg = [], []
            for i, first, levels in _features(b.column(1)):
                x = token_scores(m, levels)
                size[i : i + len(first) - 1] = np.diff(first)
                hot = np.unique(np.searchsorted(first, np.flatnonzero(x > 0), "right") - 1)
                for r in hot.tolist():
                    got = maximal_segments(x[first[r] : first[r + 1]])
                    top = max(got, key=lambda g: g[2])
                    best[i + r] = top[:2]
                    count[i + r] = len(got)
                    doc += [i + r] * len(got)
                    seg += [g[2] for g in got]
            ev = evidence(m, size, np.array(doc, np.int64), np.array(seg, float))
            s = 1 / (1 + np.exp(-np.clip(m.intercept + m.slope * ev, -35, 35)))
            some = count > 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(count), pa.array(best[:, 0], mask=~some), pa.array(best[:, 1], mask=~some)], names=["doc_id", "score", "n_segments", "top_start", "top_end"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, n_segments long, top_start long, top_end long")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of whole ``documents``, learned from ``labels`` outside the held-out fold."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    m = fit(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    return score(docs, m).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_segments", "top_start", "top_end")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of THRESHOLD or more go.

    Each row is judged by its own text. Null and empty texts stay (unless most training texts are toxic); all columns stay, whatever their names.
    """
    m = fit(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))

    text_at = docs.columns.index("text")
    names = docs.columns

    def run(batches):
        for b in batches:
            n = b.num_rows
            size = np.zeros(n, np.int64)
            doc, seg = [], []
            for i, first, levels in _features(b.column(text_at)):
                x = token_scores(m, levels)
                size[i : i + len(first) - 1] = np.diff(first)
                for r in np.unique(np.searchsorted(first, np.flatnonzero(x > 0), "right") - 1).tolist():
                    got = maximal_segments(x[first[r] : first[r + 1]])
                    doc += [i + r] * len(got)
                    seg += [g[2] for g in got]
            ev = evidence(m, size, np.array(doc, np.int64), np.array(seg, float))
            s = 1 / (1 + np.exp(-np.clip(m.intercept + m.slope * ev, -35, 35)))
            yield pa.RecordBatch.from_arrays(b.columns, names=names).filter(pa.array(s < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
