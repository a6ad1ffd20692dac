"""The manifest against a plain recursion over Python lists."""

import hashlib
import random
import zlib

from laddersmith.llm import merkle
from laddersmith.llm.merkle import manifest, op11_merkle_manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """All levels over a list of digests."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    """(before, after) at each level."""
    out = []
    for nodes in levels[:-1]:
        s = i // 8 * 8
        out.append((nodes[s:i], nodes[i + 1 : s + 8]))
        i //= 8
    return out


def brute(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows of the five columns."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = climb([x[2] for x in groups[g]])
    top = climb([trees[g][-1][0] for g in order])
    root = top[-1][0]
    out = []
    for n, g in enumerate(order):
        for i, (_, _, lf, r) in enumerate(groups[g]):
            path = siblings(trees[g], i) + siblings(top, n)
            proof = h(*(x for a, b in path for x in a + b))
            acc = lf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                acc = leaf((*r[:4], r[4] if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in path:
                acc = h(*a, acc, *b)
            out.append((r[0], lf, trees[g][-1][0], root, proof, acc, acc == root))
    return out


def key(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


COLS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_every_row_of_the_corpus(spark, sf):
    got = [tuple(r) for r in op11_merkle_manifest(spark, sf).select(*COLS).collect()]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*merkle.COLUMNS).collect()]
    want = brute(rows)
    assert key(got) == key(want)
    assert {w[-1] for w in want} == {True, False}


def test_many_partitions_and_groups_of_all_sizes(spark, monkeypatch):
    """Groups of 1 to 4,700 rows, one with most rows, over small partitions: ragged ends at every level; blocks of two levels take several rounds."""
    monkeypatch.setattr(merkle, "LEAVES", 97)
    monkeypatch.setattr(merkle, "LEVELS", 2)
    rng = random.Random(1)
    sizes = {None: 9, "": 1, "a": 8, "b": 64, "c": 65, "é": 513, "z": 4700} | {f"g{i}": 2 for i in range(20)}
    rows = [(rng.randrange(10**9), "s", g, i, f"text {i}") for g, n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = manifest(df).select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(merkle.F.col("path")).alias("p"), merkle.fold_proof(merkle.F.col("leaf"), merkle.F.col("path")).alias("f")).collect()
    want = [(w[0], w[1], w[2], w[3], w[4], w[3]) for w in brute(rows)]
    assert key(map(tuple, got)) == key(want)


def test_one_row_and_copies(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    one = (5, None, None, None, None)
    r = manifest(spark.createDataFrame([one], schema)).first()
    assert r.leaf == r.subroot == r.root == leaf(one) and r.path == []
    copies = [(1, "s", "en", 1, "x")] * 30
    got = manifest(spark.createDataFrame(copies, schema)).select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(merkle.F.col("path")).alias("p")).collect()
    assert key(map(tuple, got)) == key(w[:5] for w in brute(copies))


def test_empty_table(spark, empty):
    out = op11_merkle_manifest(spark, empty)
    assert out.count() == 0 and out.columns == list(COLS)
