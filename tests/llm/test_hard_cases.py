"""Cases that once went wrong: colliding hashes, blocks and repeated ids, clashing columns, long texts."""

import math
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from laddersmith.llm import decontaminate, html_text, near_dup, ppm, quality, suffix_dedup, toxicity
from laddersmith.llm import words as W


def thue_morse(n, a="a", b="b"):
    x = a
    while len(x) < n:
        x += x.translate(str.maketrans(a + b, b + a))
    return x


@pytest.mark.parametrize("n", [8, 64, 256, 1024, 4096])
def test_thue_morse_strings_hash_apart(n):
    s = thue_morse(n)
    t = s.translate(str.maketrans("ab", "ba"))
    col = pa.array([s, t, s])
    for _, _, raw, offs in W.chunks(col):
        h, *_ = W.word_hashes(raw, offs, W.SPACE)
        assert h[0] == h[2] != h[1]
        if n >= 64:
            w = W.window_hashes(raw, n)
            assert w[0] == w[2 * n] != w[n]


def test_span_hashes_depend_on_bytes_alone():
    rng = np.random.default_rng(1)
    buf = rng.integers(0, 3, 4000).astype(np.uint8)
    s = rng.integers(0, 3500, 500)
    e = s + rng.integers(0, 400, 500)
    h = W.span_hashes(buf, s, e)
    by = defaultdict(set)
    for i, (a, b) in enumerate(zip(s, e, strict=True)):
        by[buf[a:b].tobytes()].add(int(h[i]))
        assert int(W.span_hashes(buf[a:b].copy(), np.array([0]), np.array([b - a]))[0]) == int(h[i])
    assert all(len(x) == 1 for x in by.values()) and len({min(x) for x in by.values()}) == len(by)


def test_colliding_words_are_no_near_duplicates(spark):
    s = thue_morse(1024)
    rows = [(1, s), (2, s.translate(str.maketrans("ab", "ba"))), (3, s)]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


ITEMS = [(10, "alpha beta gamma delta epsilon zeta eta theta"), (11, "one two three four five six seven eight nine"), (12, "red orange yellow green blue indigo violet white")]
DOCS = [(1, "x " + ITEMS[0][1] + " y " + ITEMS[2][1]), (1, "before " + ITEMS[1][1]), (1, "a clean text with no item in it at all"), (None, ITEMS[0][1]), (2, None), (3, "")]


@pytest.mark.parametrize("block", [1, 60, 1 << 20])
def test_blocks_and_repeated_ids(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = [(r.doc_id, tuple(sorted(m.item_id for m in r.matches))) for r in decontaminate.contamination(docs, items).collect()]
    assert Counter(got) == Counter([(1, (10, 12)), (1, (11,)), (1, ()), (None, (10,)), (2, ()), (3, ())])


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_a_clean_row_stays_beside_its_namesake(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(*d, "own", 7) for d in DOCS], "doc_id long, text string, matches string, key int")
    out = decontaminate.stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([DOCS[2], DOCS[4], DOCS[5]])


def test_toxicity_with_clashing_columns(spark, tmp_path):
    bad, good = "you stupid idiot scum go away now", "the lake was calm and the boats came home"
    rows = [(i, (bad if i % 3 == 0 else good) + f" w{i % 7}", "own", "own", "own") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, _id string, _doc string")
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = toxicity.stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {i for i in range(120) if i % 3}


def test_scores_against_a_plain_scorer(spark, tmp_path):
    """A fitted model's scores, word by word in Python."""
    import random

    from conftest import prose

    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(0, 60)) + (" you stupid idiot scum" * rng.randint(1, 3) if i % 4 == 0 else "")) for i in range(300)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    m = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int"))
    odds = dict(zip(m.keys.tolist(), m.odds.tolist(), strict=True))
    key = lambda b: int(W.span_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0])
    import re

    want = {}
    for d, t in rows:
        xs = []
        for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()):
            b, x = w.encode(), -toxicity.DRIFT
            for part in (b[:4], b[:6], b):
                x = odds.get(key(part), x + toxicity.DRIFT) - toxicity.DRIFT
            xs.append(x)
        ev = 0.0
        for _, _, s in toxicity.maximal_segments(np.array(xs)):
            e = m.lam * s - m.log_k - math.log(max(len(xs), 1))
            ev += e if e >= -math.log(toxicity.MAX_E) else 0.0
        want[d] = 1 / (1 + math.exp(-(m.intercept + m.slope * ev)))
    got = {r.doc_id: r.score for r in toxicity.score(docs, m).collect()}
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d], abs=1e-9) for d in want)
    assert got[4] > 0.5 > got[1] and got[900] == got[901]


def test_names_that_only_contain_a_bad_word(spark):
    p = "<p>A long paragraph of the article with many words in it, and commas too, said again and again.</p>"
    page = f"<body><article><h1>T</h1>{p}<section class='social-history'><p>Kept, this one.</p></section><div class='related-work'><p>Kept, that one.</p></div><div class='social-share'>gone</div><aside>gone</aside><div class='comment-list'>gone</div>{p}</article></body>"
    got = html_text.extract(page)
    assert "Kept, this one." in got and "Kept, that one." in got and "gone" not in got


def test_a_long_text_of_mixed_scripts_takes_bounded_memory():
    rng = np.random.default_rng(2)
    text = "".join(map(chr, np.concatenate([rng.integers(0x4E00, 0x9FFF, 1_300_000), rng.integers(0x20, 0x7E, 2_000_000), rng.integers(0x400, 0x4FF, 1_000_000)])))
    tracemalloc.start()
    got = ppm.listing(pa.array([text]), np.ones(1, bool))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text.encode()) > 7.5e6 and peak < 700e6  # the test's text itself is part of it
    assert got[1][1].sum() == len(text.encode()) + 1


def test_strings_of_a_cut_text_are_those_of_the_whole(monkeypatch):
    text = "The quick brown fox, größer 漢字. " * 40
    whole = [k for _, _, k in ppm.strings(pa.array([text]))]
    monkeypatch.setattr(ppm, "CHUNK", 100)
    parts = [k for _, _, k in ppm.strings(pa.array([text]))]
    assert len(whole) == 1 and len(parts) > 5 and (np.concatenate(parts) == whole[0]).all()


def test_scores_by_rounds_of_merging(spark, sf, monkeypatch):
    want = sorted(map(tuple, ppm.op5_ppm_lm(spark, sf).collect()), key=repr)
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7)
    monkeypatch.setattr(ppm, "FAN", 2)
    monkeypatch.setattr(ppm, "BLOCK", 20_000)
    got = sorted(map(tuple, ppm.lm_scores(docs.withColumn("held_out", ppm.fold("doc_id", 7) == 2)).collect()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_repeats_in_rows_that_are_cut(spark, sf, monkeypatch):
    want = Counter(map(tuple, suffix_dedup.op6_suffix_array_dedup(spark, sf).collect()))
    monkeypatch.setattr(suffix_dedup, "PART", 700)
    monkeypatch.setattr(W, "chunks", lambda col, limit=1: _single(col))
    assert Counter(map(tuple, suffix_dedup.op6_suffix_array_dedup(spark, sf).collect())) == want


def _single(col):
    data, offs = W.buffers(col)
    for i in range(len(offs) - 1):
        yield i, i + 1, data[offs[i] : offs[i + 1]], offs[i : i + 2] - offs[i]


def test_verdicts_against_plain_quartiles(spark):
    import random

    import public_tokenizers
    from conftest import prose

    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(20, 120)) if i % 11 else " ".join(f"{rng.getrandbits(60):x}" for _ in range(60)), ("en", "de", None)[i % 3]) for i in range(400)]
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), str(public_tokenizers.path("piece_bpe_32k.model"))).collect()
    lang = {d: x for d, _, x in rows}
    even = lambda r: r.token_entropy / math.log2(max(r.n_tokens, 2))
    sound = defaultdict(list)
    for r in got:
        if not r.base_failed:
            sound[lang[r.doc_id]].append(r)
    for r in got:
        own, bad = sound[lang[r.doc_id]], False
        for f in (lambda r: r.chars_per_token, lambda r: r.fallback_share, even):
            xs = sorted(round(f(x) / quality.STEP) * quality.STEP for x in own)
            lo, hi = xs[math.ceil(0.25 * len(xs)) - 1], xs[math.ceil(0.75 * len(xs)) - 1]
            wide = quality.FENCE * max(hi - lo, 0.01 * max(abs(hi), 1.0)) * math.sqrt(1 + quality.SHORT / max(r.n_words, 1)) * (1 + quality.FEW / len(own))
            bad |= f(r) < lo - wide - 1e-9 or f(r) > hi + wide + 1e-9
        assert r.kept == (not r.base_failed and not bad), r
    assert 0 < sum(r.kept for r in got) < sum(not r.base_failed for r in got)
