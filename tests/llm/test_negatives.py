"""Hard negatives against plain loops over Python integers."""

import math
import random

import pytest

from laddersmith.llm import negatives
from laddersmith.llm.negatives import op12_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, key string, score string, kind string"
TOP = 2**63 - 1


def brute(rows):
    good = []
    for vec_id, vec, label in rows:
        if vec_id is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        q = [max(-(2**63), min(TOP, math.floor(256 * x))) for x in vec]
        good.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, q))
    out = []
    for n, (a, tag, v) in enumerate(good):
        if a % 100:
            continue
        score = lambda w, v=v: max(-TOP, min(TOP, sum(x * y for x, y in zip(v, w, strict=False))))
        others = sorted(((-score(w), b, t == tag) for m, (b, t, w) in enumerate(good) if m != n), key=lambda x: x[:2])
        for ps, p, _ in [x for x in others if x[2]][:5]:
            hits = [(b, s) for s, b, same in others if not same and 30 * -ps <= 100 * -s <= 90 * -ps][:10]
            out += [(a, p, i + 1, b, -ps, -s) for i, (b, s) in enumerate(hits)]
    return sorted(out)


def run(spark, tmp_path, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    df.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = op12_hard_negatives(spark, str(tmp_path))
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


def single(x):
    """A float as its 32 bits keep it."""
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def vectors(rng, n, dim=8):
    return [(i, [single(rng.gauss(0.3, 0.4)) for _ in range(dim)], rng.randrange(10)) for i in range(n)]


def test_many_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(negatives, "STRIPE", 3)
    monkeypatch.setattr(negatives, "ROWS", 150)
    monkeypatch.setattr(negatives, "TASKS", 7)
    rows = vectors(random.Random(3), 900)
    want = brute(rows)
    assert len(want) > 200
    assert run(spark, tmp_path, rows) == want


def test_odd_rows(spark, tmp_path):
    """Ties, repeated rows and ids, nulls, values that aren't finite, other lengths and values beyond 63 bits."""
    rng = random.Random(4)
    coarse = [(i, [float(rng.randrange(3)) for _ in range(4)], rng.randrange(3)) for i in range(320)]  # many equal scores
    odd = [(None, [1.0], 1), (401, None, 1), (402, [1.0, None], 1), (403, [float("nan")], 1), (404, [float("inf")], 1), (405, [1.0], None), (406, [], 1), (500, [], 1), (407, [1.0, 1.0, 1.0, 1.0, 1.0, 1.0], 2)]
    rows = coarse + odd + coarse[95:105] + [(200, [1.0, 2.0, 0.0, 1.0], 2), (300, [0.0, 0.0, 0.0, 0.0], 1), (600, [single(1e30), 1.0], 1), (601, [single(-1e30), 2.0], 1), (602, [single(3e12), 0.0], 2)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_hot_label(spark, tmp_path, monkeypatch):
    """A third of the rows share a vector and a label."""
    monkeypatch.setattr(negatives, "ROWS", 100)
    rng = random.Random(5)
    rows = vectors(rng, 400) + [(1000 + i, [0.5] * 8, 3) for i in range(200)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


@pytest.mark.parametrize("big", [1, 2**45, 2**61])
def test_ranking_is_a_sort_by_score_and_place(big):
    rng = random.Random(6)
    s = negatives.np.array([rng.randrange(-3, 3) * big for _ in range(500)], negatives.np.int64)
    assert negatives._ranking(s).tolist() == sorted(range(500), key=lambda i: (-int(s[i]), i))
