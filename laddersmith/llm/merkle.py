"""Merkle manifest of a dataset (operator 11).

Rows become leaves: digests of their columns. Leaves of a group (a language, say) are range-sorted; what
partitions hold of each group, counted, gives every leaf its coordinate. Each partition then builds the complete
aligned subtrees over its own leaves. Nodes at its ragged ends, a few for each level, are shuffled by coordinate and
finish the upper levels, ``LEVELS`` at a time in blocks of bounded size. The groups' roots are the leaves of
a tree of the same kind, whose root is the manifest's. A last pass gives each partition the runs at its ends and returns
each row with its proof: for each level the siblings before and after it.

Defined results: groups are ordered null first, then by UTF-8 bytes; rows ascend by the order column (null first), rows that tie by their leaf.
Rows that are the same in all columns have the same leaf and stand side by side, each with a proof of its own. A
single row is its own subroot and (alone in the table) root; its proof is that of no siblings. Extra columns take no part; an empty table gives an empty result.
Nothing is kept or sent whole: a group's size shows in its number of partitions only.
"""

from __future__ import annotations

import hashlib
from binascii import hexlify
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laddersmith.llm.common import by_group, fold, materialize, parallelism, read, ship

#: Children of a node, levels that a block of the upper tree finishes at a time, and leaves of a partition, about.
FAN, LEVELS, LEAVES = 8, 4, 1 << 18
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PATH = "array<struct<before:binary,after:binary>>"


def leaf(*cols: Column) -> Column:
    """A row's digest: each value by its length in bytes and itself, or a dash for null."""
    parts = [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in (c.cast("string") for c in cols)]
    return F.sha2(F.concat(*parts), 256)


def proof_digest(path: Column) -> Column:
    """The digest of a proof's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.lower(F.concat(F.hex(x["before"]), F.hex(x["after"])))), ""), 256)


def fold_proof(leaf_hex: Column, path: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(path, leaf_hex, lambda acc, x: F.sha2(F.concat(F.lower(F.hex(x["before"])), acc, F.lower(F.hex(x["after"]))), 256))


def _digests(run: bytes) -> bytes:
    """The node over a run of children."""
    return hashlib.sha256(hexlify(run)).digest()


def _bounds(total: int) -> list[int]:
    """Nodes of each level, from the leaves to the root."""
    out = [total]
    while out[-1] > 1:
        out.append(-(-out[-1] // FAN))
    return out


def _grow(level: int, lo: int, nodes: list[bytes], bounds: list[int]) -> Iterator[tuple[int, int, bytes, bool]]:
    """(level, first index, digests, whether they are a complete run): all that stands over consecutive nodes.

    Complete runs go on as nodes of the next level; the rest is ragged. The root is ragged too."""
    while nodes:
        hi, end = lo + len(nodes), bounds[level]
        if end == 1:
            yield level, 0, nodes[0], False
            return
        first = -(-lo // FAN) * FAN
        last = hi if hi == end else hi // FAN * FAN
        if first >= last:
            yield level, lo, b"".join(nodes), False
            return
        if first > lo:
            yield level, lo, b"".join(nodes[: first - lo]), False
        if last < hi:
            yield level, last, b"".join(nodes[last - lo :]), False
        runs = [b"".join(nodes[i - lo : min(i + FAN, last) - lo]) for i in range(first, last, FAN)]
        for i, r in zip(range(first, last, FAN), runs, strict=True):
            yield level, i, r, True
        level, lo, nodes = level + 1, first // FAN, [_digests(r) for r in runs]


def _split(run: bytes) -> list[bytes]:
    return [run[i : i + 32] for i in range(0, len(run), 32)]


def _segments(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[pa.RecordBatch]]:
    """Consecutive rows with one value of ``keys``."""
    held, last = [], None
    for b in batches:
        cols = [b.column(b.schema.get_field_index(k)) for k in keys]
        at = [0]
        if b.num_rows > 1:
            change = np.zeros(b.num_rows - 1, bool)
            for c in cols:
                code = c.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                change |= code[1:] != code[:-1]
            at += (np.flatnonzero(change) + 1).tolist()
        for s, e in zip(at, [*at[1:], b.num_rows], strict=True):
            if s == e:
                continue
            key = tuple(c[s].as_py() for c in cols)
            if held and key != last:
                yield held
                held = []
            last = key
            held.append(b.slice(s, e - s))
    if held:
        yield held


def _place(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Range-sorted ``leaves`` (g, ..., digest) with their partition ``p`` and their place ``r`` in what it holds of a group."""
    spark = leaves.sparkSession
    n = max(parallelism(spark), -(-leaves.count() // LEAVES))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema]

    def run(batches):
        p, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            g = b.column(b.schema.get_field_index("g"))
            r = np.empty(b.num_rows, np.int64)
            for i, x in enumerate(g.to_pylist()):
                seen = seen + 1 if x == last else 0
                r[i], last = seen, x
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, p), pa.int32()), pa.array(r)], names=[*b.schema.names, "p", "r"])

    keys = ["g", *order, "digest"]
    dealt = leaves.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return materialize(dealt.mapInArrow(run, ", ".join(fields) + ", p int, r long"), "merkle-placed")


def _parts(placed: DataFrame) -> DataFrame:
    """(g, p, off, m, total): where each partition's leaves of a group begin. A row for each partition and group in it."""
    held = placed.groupBy("g", "p").agg(F.count("*").alias("m"))
    w = Window.partitionBy("g")
    running = F.sum("m").over(w.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return materialize(held.select("g", "p", (running - F.col("m")).alias("off"), "m", F.sum("m").over(w).alias("total")), "merkle-parts")


def _dealt(placed: DataFrame, parts: DataFrame) -> DataFrame:
    """Each partition's rows in order again, with what ``parts`` says of them standing before them."""
    n = max(parallelism(placed.sparkSession), 1 + (placed.agg(F.max("p")).first()[0] or 0))
    rows = placed.withColumn("kind", F.lit(1)).unionByName(parts.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return rows.repartitionById(n, F.col("p")).sortWithinPartitions("p", "g", "kind", "r")


def _runs(placed: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The runs that no partition holds whole (g, level, first, nodes), and the groups' roots (g, digest)."""

    def local(batches):
        for seg in _segments(batches, ("p", "g")):
            head = seg[0].slice(0, 1).to_pylist()[0]
            digests = [x for b in seg for x in b.column("digest").to_pylist() if x is not None]
            out = [x for x in _grow(0, head["off"], digests, _bounds(head["total"])) if not x[3]]
            yield _nodes(head["g"], head["total"], out)

    slim = _dealt(placed.select("g", "p", "r", "digest"), parts)
    ragged = materialize(slim.mapInArrow(local, _NODES), "merkle-ragged")
    top = len(_bounds(parts.agg(F.max("total")).first()[0] or 1)) - 1
    all_runs, roots, carried = [], [], None
    for low in range(0, top + 1, LEVELS):
        high = low + LEVELS

        def finish(_, table, low=low, high=high):
            whole = []
            rows = table.to_pylist()
            bounds = _bounds(rows[0]["total"])
            at: dict[int, dict[int, bytes]] = {}
            for x in rows:
                for i, d in enumerate(_split(x["nodes"])):
                    at.setdefault(x["level"], {})[x["first"] + i] = d
            for level in range(low, high):
                level_nodes = at.get(level, {})
                if level >= len(bounds) - 1:
                    whole += [(level, i, d, False) for i, d in level_nodes.items()]
                    continue
                for parent in sorted({i // FAN for i in level_nodes}):
                    run = b"".join(level_nodes[i] for i in range(parent * FAN, min(parent * FAN + FAN, bounds[level])))
                    whole.append((level, parent * FAN, run, True))
                    at.setdefault(level + 1, {})[parent] = _digests(run)
            whole += [(high, i, d, False) for i, d in at.get(high, {}).items()]
            return pa.Table.from_batches([_nodes(rows[0]["g"], rows[0]["total"], whole)])

        nodes = ragged.where(F.col("level").between(low, high - 1))
        nodes = nodes if carried is None else nodes.unionByName(carried)
        # a block is all nodes below one node of the level that the round ends with: at most FAN ** LEVELS of the lowest level
        span = F.pow(F.lit(FAN), F.lit(high) - F.col("level")).cast("long")
        keyed = nodes.select("*", F.explode(F.expr("sequence(first, first + length(nodes) div 32 - 1)")).alias("i"))
        keyed = keyed.select("g", "total", "level", F.col("i").alias("first"), F.expr("substring(nodes, cast(32 * (i - first) + 1 as int), 32)").alias("nodes"), F.floor(F.col("i") / span).alias("block"))
        keyed = keyed.withColumn("key", F.xxhash64("g", "block"))
        # blocks whose keys collide are told apart before they are finished
        done = by_group(keyed.select("key", "g", "block", "total", "level", "first", "nodes"), "key", _each_block(finish), _NODES, ["g", "block"])
        done = materialize(done, f"merkle-upper-{low}")
        all_runs.append(done.where("complete"))
        roots.append(done.where(~F.col("complete") & (F.col("level") < high)))
        carried = done.where(~F.col("complete") & (F.col("level") == high))
    roots.append(carried)
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    return union(all_runs).select("g", "level", "first", "nodes"), union(roots).select("g", F.col("nodes").alias("digest"))


_NODES = "g string, total long, level int, first long, nodes binary, complete boolean"


def _nodes(g: str, total: int, found: list[tuple[int, int, bytes, bool]]) -> pa.RecordBatch:
    level, first, nodes, complete = zip(*found, strict=True) if found else ((), (), (), ())
    n = len(found)
    return pa.RecordBatch.from_arrays([pa.array([g] * n, pa.string()), pa.array([total] * n, pa.int64()), pa.array(level, pa.int32()), pa.array(first, pa.int64()), pa.array(nodes, pa.binary()), pa.array(complete, pa.bool_())], names=["g", "total", "level", "first", "nodes", "complete"])


def _each_block(finish):
    def run(key, table):
        out = []
        for seg in _segments(iter(table.combine_chunks().to_batches()), ("g", "block")):
            out.append(finish(key, pa.Table.from_batches(seg)))
        return pa.concat_tables(out)

    return run


def _frames(parts: DataFrame, runs: DataFrame) -> DataFrame:
    """``parts`` with the runs that a partition's ends need from outside: at most two for each level."""
    # levels below the root: the octal digits of the last leaf's index
    height = F.when(F.col("total") > 1, F.ceil(F.length(F.bin(F.col("total") - 1)) / 3)).otherwise(0)
    levels = parts.where("total > 1").select("g", "p", "off", "m", F.explode(F.sequence(F.lit(0), (height - 1).cast("int"))).alias("level"))
    width = F.pow(F.lit(FAN), F.col("level") + 1).cast("long")
    ends = F.array_distinct(F.array(F.floor(F.col("off") / width), F.floor((F.col("off") + F.col("m") - 1) / width)))
    wanted = levels.select("g", "p", "level", F.explode(F.transform(ends, lambda x: x * FAN)).alias("first"))
    found = wanted.join(runs, ["g", "level", "first"]).groupBy("g", "p").agg(F.collect_list(F.struct("level", "first", "nodes")).alias("edges"))
    return parts.join(found, ["g", "p"], "left")


def _proofs(placed: DataFrame, frames: DataFrame, keep: list[str]) -> DataFrame:
    """Each leaf with its proof up to the group's root: ``keep`` columns, g, digest, path."""

    def run(batches):
        for seg in _segments(batches, ("p", "g")):
            head = seg[0].slice(0, 1).to_pylist()[0]
            off, m, bounds = head["off"], head["m"], _bounds(head["total"])
            edges = {(e["level"], e["first"]): _split(e["nodes"]) for e in head["edges"] or []}
            own = [x for b in seg for x in b.column("digest").to_pylist() if x is not None]
            before, after = [], []
            lo = off
            for level in range(len(bounds) - 1):
                a, b = lo // FAN, (lo + len(own) - 1) // FAN
                runs = []
                for parent in range(a, b + 1):
                    s, e = parent * FAN, min(parent * FAN + FAN, bounds[level])
                    runs.append(own[s - lo : e - lo] if s >= lo and e <= lo + len(own) else edges[level, s])
                pre = [[b"".join(r[:i]) for i in range(len(r))] for r in runs]
                post = [[b"".join(r[i + 1 :]) for i in range(len(r))] for r in runs]
                before.append((lo, a, pre))
                after.append((lo, a, post))
                own, lo = [_digests(b"".join(r)) for r in runs], a
            at = 0
            for b in seg:
                b = b.filter(pc.equal(b.column("kind"), 1))
                if not b.num_rows:
                    continue
                place = off + at + np.arange(b.num_rows)
                at += b.num_rows
                pre, post = [], []
                for level, ((_, a, x), (_, _, y)) in enumerate(zip(before, after, strict=True)):
                    node = place // FAN**level
                    run_, i = (node // FAN - a).tolist(), (node % FAN).tolist()
                    pre.append([x[j][k] for j, k in zip(run_, i, strict=True)])
                    post.append([y[j][k] for j, k in zip(run_, i, strict=True)])
                h = len(pre)
                flat = [pa.array([v for row in zip(*z, strict=True) for v in row] if h else [], pa.binary()) for z in (pre, post)]
                path = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * h, pa.int32()), pa.StructArray.from_arrays(flat, names=["before", "after"]))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*keep, "g", "digest")), path], names=[*keep, "g", "digest", "path"])

    types = dict(placed.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in (*keep, "g", "digest")) + f", path {_PATH}"
    return _dealt(placed, frames).mapInArrow(run, schema)


def _tree(leaves: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    placed = _place(leaves, order)
    parts = _parts(placed)
    runs, roots = _runs(placed, parts)
    return placed, _frames(parts, runs), roots


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", order: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """(``order``, ``carry``'s columns, leaf, subroot, root, path): every row's place in the tree over ``columns``, digests as lower-case hex, the path as bytes.

    ``fold_proof`` leads from a leaf and its path to the root; ``proof_digest`` is a proof's digest."""
    ship(docs.sparkSession)
    carry = carry or {}
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = docs.select(F.col(order).alias("order_key"), g.alias("g"), F.unhex(leaf(*(F.col(c) for c in columns))).alias("digest"), *(c.alias(f"carry_{k}") for k, c in carry.items()))
    placed, frames, roots = _tree(materialize(leaves, "merkle-leaves"), ["order_key"])
    # the groups' roots in a tree of their own
    roots = materialize(roots.select(F.lit("").alias("g"), F.col("g").alias("member"), "digest"), "merkle-roots")
    top, top_frames, root = _tree(roots, ["member"])
    above = _proofs(top, top_frames, ["member"]).select(F.col("member").alias("g"), F.col("digest").alias("subroot"), F.col("path").alias("above")).crossJoin(F.broadcast(root.select(F.col("digest").alias("root"))))
    kept = [c for c in placed.columns if c == "order_key" or c.startswith("carry_")]
    rows = _proofs(placed, frames, kept).join(above, "g")
    out = lambda c: F.lower(F.hex(c))
    return rows.select(F.col("order_key").alias(order), *(F.col(f"carry_{k}").alias(k) for k in carry), out("digest").alias("leaf"), out("subroot").alias("subroot"), out("root").alias("root"), F.concat("path", "above").alias("path"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, proofs and the verification of rows of which a third is tampered with."""
    docs = read(spark, sf_dir, "documents", *COLUMNS)
    changed = leaf(*(F.translate("text", _UPPER, _UPPER.lower()) if c == "text" else F.col(c) for c in COLUMNS))
    tampered = F.when(fold("doc_id", 3) == 0, F.unhex(changed))
    rows = manifest(docs, carry={"tampered": tampered})
    folded = fold_proof(F.coalesce(F.lower(F.hex("tampered")), F.col("leaf")), F.col("path"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 of a decimal id, bit by bit: each byte is added once and shifted eight times.
_CRC = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295)"""


def _sql_leaf(text: str) -> str:
    cols = [("CAST(doc_id AS VARCHAR)",), ("source",), ("lang",), ("CAST(n_chars AS VARCHAR)",), (text,)]
    return "sha256(" + " || ".join(f"coalesce(CAST(octet_length(encode({c})) AS VARCHAR) || ':' || {c}, '-')" for (c,) in cols) + ")"


SQL = f"""WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '') AS g, {_sql_leaf("text")} AS leaf,
    CASE WHEN {_CRC} % 3 = 0 THEN {_sql_leaf(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")} END AS tampered FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
tree AS (SELECT 0 AS level, g, place AS i, leaf AS h FROM placed
  UNION ALL SELECT level + 1, g, i // 8, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM tree) WHERE n > 1 GROUP BY level, g, i // 8),
height AS MATERIALIZED (SELECT g, max(level) AS top, arg_max(h, level) AS subroot FROM tree GROUP BY g),
uppers AS (SELECT 0 AS level, row_number() OVER (ORDER BY g) - 1 AS i, subroot AS h FROM height
  UNION ALL SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM uppers) WHERE n > 1 GROUP BY level, i // 8),
peak AS MATERIALIZED (SELECT max(level) AS top, arg_max(h, level) AS root FROM uppers),
ranked AS MATERIALIZED (SELECT g, row_number() OVER (ORDER BY g) - 1 AS place FROM height),
path AS MATERIALIZED (SELECT p.id, t.level, p.place // CAST(pow(8, t.level) AS BIGINT) AS mine, t.i, t.h FROM placed p JOIN height USING (g) JOIN tree t ON t.g = p.g AND t.level < height.top AND t.i // 8 = p.place // CAST(pow(8, t.level + 1) AS BIGINT)
  UNION ALL SELECT p.id, height.top + u.level, r.place // CAST(pow(8, u.level) AS BIGINT), u.i, u.h FROM placed p JOIN height USING (g) JOIN ranked r USING (g) JOIN uppers u ON u.level < (SELECT top FROM peak) AND u.i // 8 = r.place // CAST(pow(8, u.level + 1) AS BIGINT)),
steps AS MATERIALIZED (SELECT id, level, coalesce(string_agg(h, '' ORDER BY i) FILTER (WHERE i < mine), '') AS before, coalesce(string_agg(h, '' ORDER BY i) FILTER (WHERE i > mine), '') AS after FROM path GROUP BY id, level),
proofs AS MATERIALIZED (SELECT id, sha256(string_agg(before || after, '' ORDER BY level)) AS proof FROM steps GROUP BY id),
up AS (SELECT id, 0 AS level, coalesce(tampered, leaf) AS h FROM placed
  UNION ALL SELECT up.id, up.level + 1, sha256(s.before || up.h || s.after) FROM up JOIN steps s ON s.id = up.id AND s.level = up.level),
folded AS (SELECT id, arg_max(h, level) AS folded_root FROM up GROUP BY id)
SELECT doc_id, leaf, subroot, (SELECT root FROM peak) AS root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = (SELECT root FROM peak) AS verified
FROM placed JOIN height USING (g) JOIN folded USING (id) LEFT JOIN proofs USING (id)"""
