"""Exact removal of long repeated byte strings by shard suffix arrays (operator 6).

A byte goes when a string of ``least`` bytes that covers it also starts anywhere else, in
the same document or another.

1. Every start p has one anchor: the leftmost k-byte string of least hash inside
   [p, p + least). Equal windows have equal anchors, so windows are dealt by anchor. A run is
   the starts that share an anchor; its region is the bytes that their windows cover. Windows of
   one run differ, so a run whose anchor has no other run repeats nowhere: after one count it goes no further.
2. Equal regions of one anchor repeat as wholes. They are counted by 128-bit BLAKE2b digests of their bytes, with map-side combining; this settles the bulk of copies.
3. Regions that occur once, under an anchor that has several, go to shards by anchor. Each
   shard builds one suffix array by induced sorting and reads repeats off the permuted common
   prefixes. Anchors with more than ``HOT`` different regions are dealt by each window's 128-bit hash
   instead, so that no shard grows with a hot passage.
4. The spans found are merged per document and cut out.

Text crosses the network twice, and only documents with an open region do so the first time.

Defined results: null or empty texts give zero counts and the digest of no bytes; repeated rows
count as other places, so they remove each other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laddersmith.llm import suffix as S
from laddersmith.llm import words as W
from laddersmith.llm.common import by_group, discard, materialize, parallelism, read

U = np.uint64
#: Regions of one anchor above which its windows are dealt singly.
HOT = 2000
#: Bytes of regions that a shard holds, about; starts of a long row that are scanned together.
SHARD, PART = 2 << 20, 4 << 20
_LOW = U((1 << 24) - 1)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, by block prefixes and suffixes."""
    n = len(x)
    m = -(-n // w) * w
    y = np.full(m, np.iinfo(np.uint64).max, U)
    y[:n] = x
    y = y.reshape(-1, w)
    fwd = np.minimum.accumulate(y, axis=1).ravel()
    bwd = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(bwd[: n - w + 1], fwd[w - 1 : n])


def runs(buf: np.ndarray, offs: np.ndarray, least: int, k: int) -> tuple[np.ndarray, ...]:
    """(row, start in the row, starts, anchor hash, both halves of the region's digest) of each run of starts with one anchor."""
    none = np.zeros(0, np.int64)
    if len(buf) < least:
        return (none,) * 6
    kh = W.window_hashes(buf, k)
    at = np.arange(len(kh))
    if len(buf) <= 1 << 24:
        key = (kh & ~_LOW) | at.astype(U)
        low = _LOW
    else:
        low = U((1 << 34) - 1)
        key = (kh & ~low) | at.astype(U)
    anchor = (_sliding_min(key, least - k + 1) & low).astype(np.int64)
    size = np.diff(offs)
    count = np.maximum(size - least + 1, 0)
    row = np.repeat(np.arange(len(size)), count)
    first = np.zeros(len(size) + 1, np.int64)
    np.cumsum(count, out=first[1:])
    p = offs[:-1][row] + np.arange(len(row)) - first[:-1][row]
    if not len(p):
        return (none,) * 6
    a = anchor[p]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (row[1:] != row[:-1])])
    i = np.flatnonzero(new)
    n = np.diff(np.append(i, len(p)))
    s = p[i]
    raw = memoryview(np.ascontiguousarray(buf))
    digest = b"".join(hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(s.tolist(), (s + n + least - 1).tolist(), strict=True))
    region = np.frombuffer(digest, np.int64).reshape(-1, 2)
    return row[i], s - offs[:-1][row[i]], n, kh[a[i]].view(np.int64), region[:, 0], region[:, 1]


def _merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans, in order, of the union (touching spans join)."""
    o = np.argsort(start, kind="stable")
    start, end = start[o], np.maximum.accumulate(end[o])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    i = np.flatnonzero(new)
    return start[i], end[np.append(i[1:], len(end)) - 1]


def repeated_spans(docs: DataFrame, least: int, k: int) -> DataFrame:
    """(key, spans array<struct<s long, e long>>): bytes to remove from documents that have any.

    ``docs``: (key long, text string); equal keys mean equal texts.
    """
    spark = docs.sparkSession

    def scan(batches):
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for i, _, buf, offs in W.chunks(b.column(1)):
                # a long row is scanned in parts; a run that is cut there makes two regions of one anchor, which step 3 compares like any others
                for a in range(0, max(len(buf) - least + 1, 1), PART) if len(offs) == 2 else (0,):
                    part = buf[a : a + PART + least - 1] if len(offs) == 2 else buf
                    row, p, n, ah, r1, r2 = runs(part, offs if len(offs) > 2 else np.array([0, len(part)]), least, k)
                    yield pa.RecordBatch.from_arrays([pa.array(ah), pa.array(r1), pa.array(r2), pa.array(keys[i + row]), pa.array(p + a), pa.array(n)], names=["anchor", "region", "region2", "key", "p", "n"])

    every = materialize(docs.mapInArrow(scan, "anchor long, region long, region2 long, key long, p long, n long"), "repeat-runs")
    shared = materialize(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("anchor"), "repeat-anchors")
    # dealt by document: files that hold one hot anchor's runs would leave the next joins nothing to split
    found = materialize(every.join(shared, "anchor").repartition("key"), "repeat-runs-shared")
    discard(every)
    discard(shared)
    same = ["anchor", "region", "region2"]
    variants = found.groupBy(*same).agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("key"))
    variants = materialize(variants, "repeat-variants")
    whole = variants.where("c > 1").select(*same)
    settled = found.join(whole, same).select("key", F.col("p").alias("s"), (F.col("p") + F.col("n") + (least - 1)).alias("e"))

    several = variants.groupBy("anchor").agg(F.count(F.lit(1)).alias("v"), F.min("c").alias("least_c")).where("v > 1 and least_c = 1").select("anchor", "v")
    open_ = variants.join(several, "anchor").select(*same, "c", "v", "key")
    want = found.join(open_, [*same, "key"]).groupBy(*same, "key", "c", "v").agg(F.min("p").alias("p"), F.max("n").alias("n"))
    want = materialize(want.groupBy("key").agg(F.collect_list(F.struct("anchor", "c", "v", "p", "n")).alias("w")), "repeat-open")

    def cut(batches):
        for b in batches:
            data, offs = W.buffers(b.column(1))
            rows = []
            for r, (key, ws) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                for w in ws:
                    s = offs[r] + w["p"]
                    rows.append((w["anchor"], w["c"], w["v"], key, w["p"], w["n"], data[s : s + w["n"] + least - 1].tobytes()))
            names = ["anchor", "c", "v", "key", "p", "n", "bytes"]
            types = [pa.int64()] * 6 + [pa.binary()]
            for i in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 2000], strict=True), types, strict=True)], names=names)

    once = docs.join(want, "key").select("key", "text", "w")  # equal rows have c > 1 in every run, and stand for one another
    regions = once.mapInArrow(cut, "anchor long, c long, v long, key long, p long, n long, bytes binary")
    regions = materialize(regions.dropDuplicates(["anchor", "key", "p"]), "repeat-regions")
    total = regions.agg(F.sum(F.length("bytes"))).head()[0] or 0
    shards = max(parallelism(spark), int(total // SHARD) + 1)

    def shard(_, t: pa.Table):
        hits = S.repeated_starts(t["bytes"].to_pylist(), least)
        key, p, c = t["key"].to_numpy(), t["p"].to_numpy(), t["c"].to_numpy()
        ks, ss, es = [], [], []
        for i, h in enumerate(hits):
            if len(h) and c[i] == 1:
                s, e = _merge(h, h + least)
                ks.append(np.full(len(s), key[i]))
                ss.append(p[i] + s)
                es.append(p[i] + e)
        return pa.table({"key": np.concatenate(ks), "s": np.concatenate(ss), "e": np.concatenate(es)}) if ks else None

    span = "key long, s long, e long"
    cold = regions.where(f"v <= {HOT}").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    edges = by_group(cold, "shard", shard, span, ["anchor", "key", "p"], shards)

    def windows(batches):
        for b in batches:
            key, p, n = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
            for i, _, buf, offs in W.chunks(b.column(6)):
                row = np.repeat(np.arange(len(offs) - 1), n[i : i + len(offs) - 1])
                o = np.arange(len(row)) - np.repeat(np.cumsum(n[i : i + len(offs) - 1]) - n[i : i + len(offs) - 1], n[i : i + len(offs) - 1])
                at = offs[row] + o
                h, h2 = (W.window_hashes(buf, least, seed)[at] if len(at) else np.zeros(0, U) for seed in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(key[i + row]), pa.array(p[i + row] + o)], names=["h", "h2", "key", "s"])

    hot = materialize(regions.where(f"v > {HOT}").mapInArrow(windows, "h long, h2 long, key long, s long"), "repeat-windows")
    twice = materialize(hot.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h", "h2"), "repeat-windows-twice")
    windowed = hot.join(twice, ["h", "h2"]).select("key", "s", (F.col("s") + least).alias("e"))
    spans = settled.unionByName(edges).unionByName(windowed).groupBy("key").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    spans = materialize(spans, "repeat-spans")
    for done in (found, variants, want, regions, hot, twice):
        discard(done)
    return spans


def remove_repeats(docs: DataFrame, least: int = 400, k: int = 64) -> DataFrame:
    """Rows of ``docs`` with text_kept, n_bytes, n_removed, n_spans and kept_sha256; other columns stay.

    Columns of ``docs`` that have these names are replaced; ``text`` stays as it is. text_kept
    leaves out the bytes of a character that a removal broke; kept_sha256 is over all that remain.    """
    base = docs.withColumn("_key", F.xxhash64(F.col("doc_id").cast("string"), F.col("text")))
    spans = repeated_spans(base.select(F.col("_key").alias("key"), "text"), least, k)
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "text_kept"]
    joined = base.drop(*names).join(spans.select(F.col("key").alias("_k2"), F.col("spans").alias("_spans")), F.col("_key") == F.col("_k2"), "left").drop("_k2", "_key")
    keep = [c for c in joined.columns if c != "_spans"]
    text_at, spans_at = joined.columns.index("text"), joined.columns.index("_spans")

    def run(batches):
        for b in batches:
            data, offs = W.buffers(b.column(text_at))
            data = memoryview(data)
            size, gone, count, sha, kept = [], [], [], [], []
            lists = b.column(spans_at)
            flat, lo = lists.flatten(), np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            fs, fe = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)) if len(flat) else (np.zeros(0, np.int64),) * 2
            for r in range(b.num_rows):
                x = data[offs[r] : offs[r + 1]]
                size.append(len(x))
                if lo[r] == lo[r + 1]:
                    gone.append(0)
                    count.append(0)
                    left = x.tobytes()
                else:
                    s, e = _merge(fs[lo[r] : lo[r + 1]], fe[lo[r] : lo[r + 1]])
                    parts = [x[i:j] for i, j in zip([0, *e.tolist()], [*s.tolist(), len(x)], strict=True)]
                    left = b"".join(parts)
                    gone.append(int((e - s).sum()))
                    count.append(len(s))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "ignore"))
            cols = [c for i, c in enumerate(b.columns) if i != spans_at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(kept, pa.string()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())], names=[*keep, *names[4:], *names[:4]])

    from pyspark.sql.types import StructType

    schema = StructType([joined.schema[c] for c in keep]).add("text_kept", "string")
    schema = schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    return joined.mapInArrow(run, schema)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of 400 bytes over whole ``documents``; ``text`` is what is left of each."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("text_kept").alias("text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeats of 200 bytes (a passage of 50 words is longer) from the texts; every row stays.

    n_chars is counted anew where a text changed. Null texts stay null, empty ones empty; of repeated rows both lose what they share; all
    columns stay, whatever their names; an empty table gives an empty result.
    """
    cols = docs.columns
    inner = [c if c in ("doc_id", "text") else f"_c{i}" for i, c in enumerate(cols)]  # names of the documents' own can't clash with ours
    out = remove_repeats(docs.toDF(*inner), least=200, k=48)
    out = out.withColumn("text", F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("text_kept")))
    if "n_chars" in cols:
        n = inner[cols.index("n_chars")]
        out = out.withColumn(n, F.when(F.col("n_removed") == 0, F.col(n)).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*inner).toDF(*cols)
