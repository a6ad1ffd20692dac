"""Benchmark items inside long documents by size-partitioned MinHash containment (operator 9).

The items are a stated set of queries: they go over all documents in blocks of at most BLOCK
bytes of text, one pass a block, so what is broadcast has a fixed bound. Items are
partitioned by size. A partition of at most u shingles indexes, for each item, its u - ceil(t * u) + 1
least hash values (a bottom MinHash sample). An item with a share t of its shingles in a document lacks too few of
them to lose all of its sample, so every true match becomes a candidate, however long the
document is. (A MinHash sketch of the document would not do: a short item in a long document
has a Jaccard similarity near zero.) Candidates are verified by exact shingle containment.

Defined results: null or empty texts and items match nothing; an item of fewer than k words is
one shingle and matches only a document that is that sequence; repeated documents are judged
one by one; of repeated item ids each text counts; extra columns are ignored; no items, or no documents, give no matches.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laddersmith.llm import words as W
from laddersmith.llm.common import materialize, read

#: Bytes of item text in a block.
BLOCK = 16 << 20
#: Upper sizes of the partitions grow by this factor.
STEP = 1.25
U = np.uint64
_BITS = U((1 << 22) - 1)


class Index:
    """Postings of the samples of a block of items, and the items' whole sets."""

    def __init__(self, ids: list[int], texts: list[str], k: int, percent: int):
        col = pa.array(texts, pa.string())
        self.sets: list[np.ndarray] = []
        for i, j, raw, offs in W.chunks(col):
            wh, _, _, first = W.word_hashes(W.LOWER[raw], offs, W.SPACE)
            sh, at = W.shingle_hashes(wh, first, k)
            self.sets += [W.distinct(sh[at[r] : at[r + 1]]) for r in range(j - i)]
        self.ids, self.k, self.percent = np.array(ids, np.int64), k, percent
        keys, items = [], []
        for i, s in enumerate(self.sets):
            if not len(s):
                continue
            upper = 1
            while upper < len(s):
                upper = max(upper + 1, int(upper * STEP))
            n = min(len(s), upper - math.ceil(upper * percent / 100) + 1)
            keys.append(s[:n])  # the sets are sorted hashes: their least come first
            items.append(np.full(n, i))
        keys, items = np.concatenate(keys or [np.zeros(0, U)]), np.concatenate(items or [np.zeros(0, np.int64)])
        o = np.argsort(keys, kind="stable")
        self.keys, self.items = keys[o], items[o]
        self.maybe = np.zeros(int(_BITS) + 1, bool)
        self.maybe[(self.keys & _BITS).astype(np.int64)] = True

    def matches(self, shingles: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, shared shingles) of the verified matches; ``at``: each row's first shingle."""
        i = np.flatnonzero(self.maybe[(shingles & _BITS).astype(np.int64)])
        lo, hi = np.searchsorted(self.keys, shingles[i], "left"), np.searchsorted(self.keys, shingles[i], "right")
        hit = hi > lo
        i, lo, hi = i[hit], lo[hit], hi[hit]
        row = np.searchsorted(at, i, "right") - 1
        n = hi - lo
        post = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        pairs = np.unique(np.repeat(row, n) * len(self.ids) + self.items[post]) if len(post) else np.zeros(0, np.int64)
        out, last, own = [], -1, None
        for p in pairs.tolist():
            r, item = divmod(p, len(self.ids))
            if r != last:
                last, own = r, W.distinct(shingles[at[r] : at[r + 1]])
            s = self.sets[item]
            pos = np.minimum(np.searchsorted(own, s), len(own) - 1)
            common = int((own[pos] == s).sum())
            if 100 * common >= self.percent * len(s):
                out.append((r, item, common))
        return out

    def search(self, col: pa.Array) -> list[tuple[int, int, int]]:
        """matches() of the rows of a column of texts."""
        out = []
        for i, _, raw, offs in W.chunks(col) if len(self.keys) else ():
            wh, _, _, first = W.word_hashes(W.LOWER[raw], offs, W.SPACE)
            out += [(i + r, item, common) for r, item, common in self.matches(*W.shingle_hashes(wh, first, self.k))]
        return out


def contamination(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` (doc_id, text), ``items`` (item_id, text) to (doc_id, matches array<struct<item_id, n_item, n_common>>), a row for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    indexes = _indexes(items, k, percent)
    kind = "array<struct<item_id: bigint, n_item: bigint, n_common: bigint>>"
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("n_item", pa.int64()), ("n_common", pa.int64())]))

    def find(rows: DataFrame, index, every: bool) -> DataFrame:
        """(key, matches) of rows (key, text): of ``every`` row, or of those with matches."""

        def run(batches):
            ix = index.value
            for b in batches:
                found: list[list[dict]] = [[] for _ in range(b.num_rows)]
                for r, item, common in ix.search(b.column(1)):
                    found[r].append({"item_id": int(ix.ids[item]), "n_item": len(ix.sets[item]), "n_common": common})
                out = pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(found, arrow)], names=["key", "matches"])
                yield out if every else out.filter(pa.array([bool(f) for f in found], pa.bool_()))

        return rows.mapInArrow(run, f"key long, matches {kind}")

    if len(indexes) == 1:
        return find(docs, indexes[0], True).withColumnRenamed("key", "doc_id")
    # several blocks: rows get a number, for ids may repeat, and each block brings what it found
    rows = materialize(docs.withColumn("key", F.monotonically_increasing_id()), "contamination-rows")
    parts = [materialize(find(rows.select("key", "text"), ix, False), "contamination-found") for ix in indexes]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.groupBy("key").agg(F.flatten(F.collect_list("matches")).alias("matches"))  # at most all items a row
    return rows.select("key", "doc_id").join(found, "key", "left").select("doc_id", F.coalesce("matches", F.array().cast(kind)).alias("matches"))


def _indexes(items: DataFrame, k: int, percent: int) -> list:
    """Broadcast indexes of the items, each of about BLOCK bytes of text at most (or of one item)."""
    spark = items.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK))
    out = []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()
        out.append(spark.sparkContext.broadcast(Index([r.item_id for r in rows], [r.text for r in rows], k, percent)))
    return out


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of ``benchmark`` with 80 % or more of their 5-word shingles in a document, for all ``documents``.

    Columns: doc_id, contaminated, n_items, item_ids (sorted), n_common (shared shingles, summed over the items).
    """
    found = contamination(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    common = F.aggregate("matches", F.lit(0).cast("long"), lambda a, m: a + m["n_common"])
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), common.alias("n_common"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i+4] END s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT item_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i+4] END s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) n FROM bs GROUP BY 1),
m AS (SELECT doc_id, item_id, count(*) c FROM ds JOIN bs USING (s) GROUP BY 1, 2),
g AS (SELECT doc_id, count(*) k, list(item_id ORDER BY item_id) ids, sum(c)::BIGINT c FROM m JOIN n USING (item_id) WHERE 100 * c >= 80 * n GROUP BY 1)
SELECT d.doc_id, g.k IS NOT NULL AS contaminated, coalesce(g.k, 0)::BIGINT AS n_items, coalesce(g.ids, []::BIGINT[]) AS item_ids, coalesce(g.c, 0)::BIGINT AS n_common
FROM d LEFT JOIN g USING (doc_id)
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, k: int = 5, percent: int = 80) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go; each row is judged by its own text, so of rows with one id the clean ones stay.

    Null and empty texts stay; all columns stay, whatever their names. Each block of items is a pass over the rows that are left.
    """
    at, schema = docs.columns.index("text"), docs.schema
    indexes = _indexes(read(spark, sf_dir, "benchmark", "item_id", "text"), k, percent)
    for n, index in enumerate(indexes):

        def run(batches, index=index):
            for b in batches:
                stays = np.ones(b.num_rows, bool)
                stays[[r for r, _, _ in index.value.search(b.column(at))]] = False
                yield b.filter(pa.array(stays))

        docs = docs.mapInArrow(run, schema)
        if n < len(indexes) - 1:  # one index at a time in the executors
            docs = materialize(docs, "decontaminated")
    return docs
