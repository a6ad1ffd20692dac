"""Quality rules with tokenizer fertility (operator 10).

Base: counts of words, symbols, repeated lines and words in repeated 8-word windows. Method: a public
vocabulary (pieces with byte fallback) gives each document its characters per token, its share of
fallback bytes and the entropy of its tokens. A language's bands are the quartiles of its documents
that pass the base rules, widened by FENCE times their distance, more for short documents, whose
measures vary more, and more for languages of few documents; a document outside of its language's bands is not kept.
Documents without language share one more set of bands. All documents count towards the bands. Quartiles are exact to a STEP: the measures
are counted in steps, language by language, so they don't depend on the partitioning and no task holds a language's documents.

Each distinct word of a run of texts is encoded once; words don't join across white space in this vocabulary.

Defined results: null or empty texts have zero counts and fail the base rules; their measures are null; a language without
sound documents has no bands, and none of its documents is kept (all fail the base rules); repeated rows are judged alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laddersmith.llm import words as W
from laddersmith.llm.common import materialize, read

U = np.uint64
#: Widths of the bands in distances of the quartiles; words at which a document's bands are wider by the root of two;
#: sound documents at which a language's bands are twice as wide; what the quartiles are exact to.
FENCE, SHORT, FEW, STEP = 2.0, 200, 50, 0.001
#: Languages up to which their bands are broadcast.
LANGUAGES = 10_000
CACHE = 300_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
MEASURES = ("chars_per_token", "fallback_share", "token_entropy")


def _per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between the places ``at``."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[at[1:]] - c[at[:-1]]


def base_counts(buf: np.ndarray, offs: np.ndarray) -> tuple[dict[str, np.ndarray], tuple]:
    """Base counts of each row, and its words (hashes, starts, ends, first of each row)."""
    n = len(offs) - 1
    wh, s, e, first = W.word_hashes(buf, offs, W.SPACE)
    word = np.zeros(len(buf) + 1, np.int8)
    np.add.at(word, s, 1) if len(s) else None
    np.subtract.at(word, e, 1) if len(e) else None
    inside = np.cumsum(word[:-1], dtype=np.int8) > 0 if len(buf) else np.zeros(0, bool)
    out = {"n_words": np.diff(first), "word_chars": _per_row(inside & ((buf & 0xC0) != 0x80), offs), "n_symbols": _per_row(_SYMBOL[buf], offs)}
    # lines with a word, by row
    cut = np.zeros(256, bool)
    cut[10] = True
    ls, le, lfirst = W.word_spans(buf, offs, cut)
    has = np.searchsorted(s, le) > np.searchsorted(s, ls)
    lh = W.span_hashes(buf, ls[has], le[has]) if len(ls) else np.zeros(0, U)
    row = np.repeat(np.arange(n), np.diff(lfirst))[has]
    seen = np.unique(W.mix(lh + row.astype(U) * U(0x9E3779B97F4A7C15)), return_index=True)[1]
    out["n_dup_lines"] = np.bincount(row, minlength=n) - np.bincount(row[seen], minlength=n)
    # words under windows of 8 that a row has twice
    full = np.where(np.diff(first) >= 8, np.diff(first) - 7, 0)
    sh, _ = W.shingle_hashes(wh, first, 8)
    mine = np.where(np.diff(first) >= 8, full, (np.diff(first) > 0).astype(np.int64))
    use = np.repeat(full > 0, mine)
    row = np.repeat(np.arange(n), full)
    at = first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
    _, inv, cnt = np.unique(W.mix(sh[use] + row.astype(U) * U(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    at = at[cnt[inv] > 1]
    cover = np.zeros(len(wh) + 9, np.int64)
    np.add.at(cover, at, 1)
    np.subtract.at(cover, at + 8, 1)
    out["n_repeat_words"] = _per_row(np.cumsum(cover)[: len(wh)] > 0, first)
    return out, (wh, s, e, first)


class Fertility:
    """Encodes distinct words and measures rows."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())])
        self.clear()

    def clear(self) -> None:
        self.hash, self.start, self.size, self.ids = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, buf: np.ndarray, h: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
        words = [buf[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(s.tolist(), e.tolist(), strict=True)]
        got = self.sp.encode(words, num_threads=1)
        size = np.array([len(g) for g in got], np.int64)
        ids = np.fromiter((x for g in got for x in g), np.int64, int(size.sum()))
        start = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, ids])
        self.hash, self.start, self.size = np.concatenate([self.hash, h]), np.concatenate([self.start, start]), np.concatenate([self.size, size])
        o = np.argsort(self.hash)
        self.hash, self.start, self.size = self.hash[o], self.start[o], self.size[o]

    def measure(self, buf: np.ndarray, words: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, fallback bytes, entropy in bits) of each row."""
        wh, s, e, first = words
        n = len(first) - 1
        u, where, inv = np.unique(wh, return_index=True, return_inverse=True)
        if len(self.hash) > CACHE:
            self.clear()
        new = np.ones(len(u), bool)
        if len(self.hash):
            new = self.hash[np.minimum(np.searchsorted(self.hash, u), len(self.hash) - 1)] != u
        if new.any():
            self._learn(buf, u[new], s[where[new]], e[where[new]])
        if not len(u):
            return np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        at = np.searchsorted(self.hash, u)[inv]
        size, start = self.size[at], self.start[at]
        tok = self.ids[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]
        ends = np.concatenate([[0], np.cumsum(size)])[first]
        count = np.diff(ends)
        back = _per_row(self.is_byte[tok], ends)
        key = np.sort((np.repeat(np.arange(n), count) << 20) | tok)
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        c = np.diff(np.append(cut, len(key))).astype(float)
        row = key[cut] >> 20
        total = count[row]
        return count, back, np.bincount(row, -c / total * np.log2(c / total), n)


_KEPT: dict[str, Fertility] = {}


def _fertility(path: str) -> Fertility:
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = Fertility(path)
    return _KEPT[path]


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_fallback")


def measures(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` (doc_id, text, lang) to doc_id, lang, the base counts, n_tokens, n_fallback and token_entropy."""

    def run(batches):
        f = _fertility(path)
        for b in batches:
            for i, j, buf, offs in W.chunks(b.column(1)):
                base, words = base_counts(buf, offs)
                base["n_tokens"], base["n_fallback"], entropy = f.measure(buf, words)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).cast(pa.int64()), b.column(2).slice(i, j - i).cast(pa.string()), *(pa.array(base[c].astype(np.int64)) for c in COUNTS), pa.array(entropy)], names=["doc_id", "lang", *COUNTS, "token_entropy"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    return docs.mapInArrow(run, "doc_id long, lang string, " + ", ".join(f"{c} long" for c in COUNTS) + ", token_entropy double")


def bands(sound: DataFrame, names: dict[str, str]) -> DataFrame:
    """(_lang, b_docs, <short>1, <short>3): documents and quartiles of each measure of ``names`` (measure: short) by language."""
    steps = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.round(F.col(c) / STEP).cast("long").alias("v")) for c, s in names.items()]))
    count = sound.select("lang", steps.alias("x")).groupBy("lang", "x.s", "x.v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("lang", "s")
    below = F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rank = count.withColumn("below", below).withColumn("all", F.sum("n").over(w))
    # the least value with a quarter (three quarters) of the documents at or below it
    at = lambda q: F.min(F.when(F.col("below") >= q * F.col("all"), F.col("v"))) * STEP
    q = rank.groupBy("lang", "s").agg(F.max("all").alias("b_docs"), at(0.25).alias("q1"), at(0.75).alias("q3"))
    one = lambda s, c: F.max(F.when(F.col("s") == s, F.col(c)))
    out = q.groupBy("lang").agg(F.max("b_docs").alias("b_docs"), *[one(s, f"q{i}").alias(f"{s}{i}") for s in names.values() for i in (1, 3)])
    out = materialize(out.withColumnRenamed("lang", "_lang"), "quality-bands")
    return F.broadcast(out) if out.count() <= LANGUAGES else out


def quality(docs: DataFrame, path: str) -> DataFrame:
    """Base counts, measures, base_failed and kept of each row."""
    m = measures(docs, path)
    m = m.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    some = F.col("n_tokens") > 0
    m = m.withColumn("chars_per_token", F.when(some, F.col("word_chars") / F.col("n_tokens"))).withColumn("fallback_share", F.when(some, F.col("n_fallback") / F.col("n_tokens"))).withColumn("token_entropy", F.when(some, F.col("token_entropy")))
    # entropy grows with length; what is banded is its share of the most that so many tokens can have
    m = m.withColumn("_even", F.col("token_entropy") / F.log2(F.greatest(F.col("n_tokens"), F.lit(2)).cast("double")))
    m = materialize(m, "quality-measures")
    names = {"chars_per_token": "cpt", "fallback_share": "fb", "_even": "ev"}
    own = bands(m.where("not base_failed"), names)

    def outside(c: str, s: str):
        lo, hi = F.col(f"{s}1"), F.col(f"{s}3")
        # quartiles that fall together (no fallback at all) leave a hundredth as slack
        wide = FENCE * F.greatest(hi - lo, F.lit(0.01) * F.greatest(F.abs(hi), F.lit(1.0))) * F.sqrt(1 + SHORT / F.greatest(F.col("n_words"), F.lit(1))) * (1 + FEW / F.col("b_docs"))
        return (F.col(c) < lo - wide) | (F.col(c) > hi + wide)

    j = m.join(own, F.col("lang") == F.col("_lang"), "left")
    bad = F.coalesce(outside("chars_per_token", "cpt") | outside("fallback_share", "fb") | outside("_even", "ev"), F.lit(False))
    return j.withColumn("kept", ~F.col("base_failed") & ~bad).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", *MEASURES)


def op10_quality(spark: SparkSession, sf_dir: str, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """Quality of whole ``documents``."""
    import public_tokenizers

    return quality(read(spark, sf_dir, "documents", "doc_id", "text", "lang"), str(public_tokenizers.path(vocabulary)))
