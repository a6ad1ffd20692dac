"""MinHash near-duplicates with odd sketches (operator 3).

Each document becomes the set of its k-word shingles. Equal sets form one class; class
representatives are banded by MinHash, odd sketches (the samples folded into a parity
bitmap; Mitzenmacher, Pagh and Pham, 2014) discard dissimilar pairs within a bucket, and what is left is confirmed on the full sets.

Scale: buckets above ``BUCKET`` rows become stars without a look at sketches. In families of
candidates above ``CHUNK`` rows every member meets the family's least node first; only members that aren't linked
to it meet all the others, in pairs of chunks. No task holds more than 2 * CHUNK sets, and a task emits at most one link per document.

Defined results: null or empty texts, and texts without words, have an empty set and link
with nothing; repeated rows fall into one class; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laddersmith.llm import words as W
from laddersmith.llm.common import by_group, components, discard, materialize, parallelism, read

#: Bands of 4 rows: 20 miss a pair of similarity 0.85 with probability 4e-7, 28 (below 0.85) one of 0.8 with the same.
ROWS = 4
BITS = 512
BUCKET = 4096
CHUNK = 512
U = np.uint64


def n_bands(percent: int) -> int:
    return 20 if percent >= 85 else 28


def shingle_sets(col: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingles of each row) by runs of rows."""
    for i, j, raw, offs in W.chunks(col):
        wh, _, _, first = W.word_hashes(W.LOWER[raw], offs, W.SPACE)
        sh, at = W.shingle_hashes(wh, first, k)
        yield i, [W.distinct(sh[at[r] : at[r + 1]]) for r in range(j - i)]


def set_digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and a 128-bit digest of each set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, U)
    at = np.zeros(len(sets) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        c = np.zeros(len(flat) + 1, U)
        np.cumsum(W.mix(flat * U(salt)), out=c[1:])
        out.append(W.mix((c[at[1:]] - c[at[:-1]]) ^ sizes.astype(U)))
    return sizes, out[0], out[1]


def min_hashes(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n MinHash samples of each non-empty set (rows of empty sets are zero)."""
    rng = np.random.default_rng(20140407)
    a = rng.integers(1, 1 << 63, n, dtype=np.int64).astype(U) * U(2) + U(1)
    b = rng.integers(0, 1 << 63, n, dtype=np.int64).astype(U)
    out = np.zeros((len(sets), n), U)
    full = [r for r, s in enumerate(sets) if len(s)]
    g = 0
    while g < len(full):
        e, total = g, 0
        while e < len(full) and (e == g or total + len(sets[full[e]]) <= 1 << 16):
            total += len(sets[full[e]])
            e += 1
        flat = np.concatenate([sets[r] for r in full[g:e]])
        at = np.cumsum([0, *(len(sets[r]) for r in full[g : e - 1])])
        for i in range(n):
            x = flat * a[i]
            x += b[i]
            out[full[g:e], i] = np.minimum.reduceat(x, at)
        g = e
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of BITS bits (as words of 64) of the sets {(i, sample i)}."""
    n, k = samples.shape
    h = W.mix(samples + np.arange(1, k + 1, dtype=U) * U(0x9E3779B97F4A7C15)) % U(BITS)
    bits = np.zeros((n, BITS), np.uint8)
    for i in range(k):
        bits[np.arange(n), h[:, i].astype(np.int64)] ^= 1
    return np.packbits(bits, axis=1).view(U)


def max_distance(k: int, similarity: float) -> int:
    """The XOR population count above which the estimated similarity is under ``similarity``."""
    return int(np.ceil(BITS * (1 - np.exp(-4 * k * (1 - similarity) / BITS)) / 2))


FEATURES = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sketch binary"


def features(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Size, digest, band keys and odd sketch of each document's set."""
    bands = n_bands(percent)

    def run(batches):
        for b in batches:
            ids = b.column(0)
            for i, sets in shingle_sets(b.column(1), k):
                n, d1, d2 = set_digests(sets)
                mh = min_hashes(sets, bands * ROWS)
                keys = np.zeros((len(sets), bands), U)
                for r in range(ROWS):
                    keys = W.mix(keys * U(0xC2B2AE3D27D4EB4F) + mh[:, r::ROWS])
                keys = W.mix(keys + np.arange(bands, dtype=U)[None, :])
                keys = keys.view(np.int64)
                sk = odd_sketches(mh)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, len(sets)).cast(pa.int64()), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), lists, pa.array([x.tobytes() for x in sk], pa.binary())],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands", "sketch"],
                )

    return docs.mapInArrow(run, FEATURES)


def _bucket_links(limit: int, percent: int):
    """Candidate links within a bucket: pairs whose sizes and sketches leave the threshold possible."""

    def run(key: int, t: pa.Table) -> pa.Table | None:
        node = t["node"].to_numpy()
        n = t["n"].to_numpy()
        sk = np.frombuffer(b"".join(t["sketch"].to_pylist()), U).reshape(len(node), -1)
        a, b = [], []
        rest = np.arange(len(node))
        while len(rest) > 1:  # each turn takes one member against those after it; a star settles most
            c, rest = rest[0], rest[1:]
            near = np.bitwise_count(sk[rest] ^ sk[c]).sum(axis=1) <= limit
            near &= 100 * np.minimum(n[rest], n[c]) >= percent * np.maximum(n[rest], n[c])
            a.append(np.full(near.sum(), node[c]))
            b.append(node[rest[near]])
        a, b = np.concatenate(a or [np.zeros(0, np.int64)]), np.concatenate(b or [np.zeros(0, np.int64)])
        return pa.table({"a": a, "b": b}) if len(a) <= len(node) else _forest(a, b)

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Links (least member, member) with the same components."""
    nodes, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
    lab = _labels(len(nodes), idx[: len(a)], idx[len(a) :])
    keep = lab != np.arange(len(nodes))
    return pa.table({"a": nodes[lab[keep]], "b": nodes[keep]})


def _labels(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least index reachable, for each of n nodes."""
    lab = np.arange(n)
    while True:
        new = lab.copy()
        np.minimum.at(new, x, lab[y])
        np.minimum.at(new, y, lab[x])
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _confirm(percent: int):
    """Exact links within a tile of sets, reduced to a forest."""

    def run(key: int, t: pa.Table) -> pa.Table | None:
        node, side = t["node"].to_numpy(), t["side"].to_numpy()
        sets = [np.frombuffer(x, U) for x in t["shingles"].to_pylist()]
        n = np.array([len(s) for s in sets], np.int64)
        if len(n) < 2:
            return None
        # the intersections of all members, over blocks of shingles that two of them have
        val, inv, cnt = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = cnt > 1
        col = np.cumsum(shared) - 1
        owner = np.repeat(np.arange(len(n)), n)
        use = shared[inv]
        r, c = owner[use], col[inv[use]]
        order = np.argsort(c, kind="stable")
        r, c = r[order], c[order]
        inter = np.zeros((len(n), len(n)), np.float32)
        width = 4096
        for lo in range(0, int(shared.sum()), width):
            s, e = np.searchsorted(c, [lo, lo + width])
            m = np.zeros((len(n), width), np.float32)
            m[r[s:e], c[s:e] - lo] = 1
            inter += m @ m.T
        inter = inter.astype(np.int64)
        ok = 100 * inter >= percent * (n[:, None] + n[None, :] - inter)
        if len(np.unique(side)) > 1:
            ok &= side[:, None] != side[None, :]
        x, y = np.nonzero(np.triu(ok, 1))
        return _forest(node[x], node[y]) if len(x) else None

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text).

    Documents with 100 * intersection >= percent * union of their shingle sets are linked;
    component_id is the smallest doc_id reachable. Rows without words are their own component.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    feats = materialize(features(docs, k, percent), "near-features")
    classes = feats.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"))
    classes = materialize(classes.select(F.col("d1").alias("node"), "d2", "rep", "n"), "near-classes")
    owners = classes.select(F.col("node").alias("o_node"), F.col("rep").alias("o_rep"))
    reps = feats.join(owners, (F.col("d1") == F.col("o_node")) & F.col("doc_id").eqNullSafe(F.col("o_rep"))).dropDuplicates(["d1"])

    keys = reps.select(F.explode("bands").alias("key"), F.col("d1").alias("node"))
    keys = materialize(keys, "near-keys")
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("center")).where("size > 1")
    buckets = materialize(buckets, "near-buckets")
    members = keys.join(buckets, "key")
    stars = members.where(f"size > {BUCKET} and node <> center").select(F.col("center").alias("a"), F.col("node").alias("b"))
    small = members.where(f"size <= {BUCKET}").select("key", "node")
    small = small.join(feats.select(F.col("d1").alias("node"), F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["node"]), "node")
    limit = max_distance(n_bands(percent) * ROWS, percent / 100 - 0.25)
    links = by_group(small, "key", _bucket_links(limit, percent), "a long, b long", ["node"]).unionByName(stars).distinct()
    family = materialize(components(links, "near-families"), "near-family")
    discard(keys)
    discard(buckets)

    # the sets of the members alone, once
    sizes = family.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    member = family.join(sizes, "label").join(classes.select("node", "rep"), "node")

    def sets_of(batches):
        for b in batches:
            want = b.column(1).to_numpy()
            for i, sets in shingle_sets(b.column(0), k):
                _, d1, _ = set_digests(sets)
                mine = np.flatnonzero(d1.view(np.int64) == want[i : i + len(sets)])  # not another text of the same id
                rows = pa.array(i + mine)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in (1, 2, 3)), pa.array([sets[r].tobytes() for r in mine.tolist()], pa.binary())], names=["node", "label", "members", "shingles"])

    text = docs.join(member.select(F.col("rep").alias("m_rep"), "node", "label", "members"), F.col("doc_id").eqNullSafe(F.col("m_rep"))).select("text", "node", "label", "members")
    sets = materialize(text.mapInArrow(sets_of, "node long, label long, members long, shingles binary").dropDuplicates(["node"]), "near-sets")

    def confirm(tiles: DataFrame) -> DataFrame:
        return materialize(by_group(tiles, "tile", _confirm(percent), "a long, b long", ["side", "node"]), "near-confirmed")

    chunk = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    g = F.ceil(F.col("members") / CHUNK).cast("int")
    # a small family is one tile; in a large one every member meets the family's least node, chunk by chunk
    small = sets.where(f"members <= {CHUNK}").select("node", F.xxhash64("label").alias("tile"), F.lit(0).alias("side"), "shingles")
    large = sets.where(f"members > {CHUNK}").select("node", "label", g.alias("g"), chunk(g).alias("c"), "shingles")
    heads = large.where("node = label").select("node", "label", upto(F.col("g")).alias("c"), F.lit(0).alias("side"), "shingles")
    star = large.where("node <> label").select("node", "label", "c", F.lit(1).alias("side"), "shingles").unionByName(heads)
    confirmed = confirm(small.unionByName(star.select("node", F.xxhash64("label", "c").alias("tile"), "side", "shingles")))
    spent = [sets, confirmed]
    # those of large families that aren't linked to it meet all members: the only tiles that are pairs of chunks
    linked = confirmed.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    left = large.where("node <> label").drop("shingles").join(linked, "node", "left_anti")
    if sizes.where(f"members > {CHUNK}").head(1) and left.head(1):
        left = materialize(left, "near-left")
        count = left.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("h"))
        rest = large.join(left.select("node"), "node", "left_semi").join(count, "label").select("node", "label", chunk(F.col("h")).alias("i"), upto(F.col("g")).alias("c"), F.lit(0).alias("side"), "shingles")
        rest = rest.unionByName(large.join(count, "label").select("node", "label", upto(F.col("h")).alias("i"), "c", F.lit(1).alias("side"), "shingles"))
        more = confirm(rest.select("node", F.xxhash64("label", "i", "c").alias("tile"), "side", "shingles"))
        confirmed, spent = confirmed.unionByName(more), [*spent, left, more]
    comp = components(confirmed.distinct(), "near-components")
    for done in spent:
        discard(done)

    rep_of = classes.select("node", "rep").join(comp, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    rep_of = materialize(rep_of, "near-labels")
    least = materialize(rep_of.groupBy("label").agg(F.min("rep").alias("component_id")), "near-least")
    by_node = rep_of.join(least, "label").select(F.col("node").alias("d1"), "component_id")
    return (
        feats.select("doc_id", "n_shingles", "d1").join(by_node, "d1", "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def op3_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of whole ``documents``: 3-word shingles, similarity 0.85 or more."""
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), k=3, percent=85)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (five words, similarity 0.8): that of the least doc_id.

    Documents are told apart by doc_id, so rows that share one stay or go together. Null and empty texts, texts without words, and rows
    without id stay; all columns stay, whatever their names; an empty table gives an empty result.
    """
    found = near_duplicates(docs, k=5, percent=80).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(found, docs["doc_id"] == found["_gone"], "left_anti")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All pairs by shared shingles: for small tables.
SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(CASE WHEN len(w) < 3 THEN w ELSE w[i:i+2] END) s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n, md5(string_agg(s::VARCHAR, ',' ORDER BY s)) k FROM s GROUP BY 1),
rep AS (SELECT k, min(doc_id) r, any_value(n) n FROM n GROUP BY 1),
rs AS (SELECT s.doc_id r, s.s, rep.n FROM s JOIN rep ON s.doc_id = rep.r),
p AS (SELECT a.r x, b.r y FROM rs a JOIN rs b ON a.s = b.s AND a.r < b.r AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
reach AS (SELECT r AS v, r AS t FROM rep UNION SELECT reach.v, e.y FROM reach JOIN e ON e.x = reach.t),
c AS (SELECT v, min(t) c FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, d.doc_id = coalesce(c.c, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN rep USING (k) LEFT JOIN c ON c.v = rep.r
"""
