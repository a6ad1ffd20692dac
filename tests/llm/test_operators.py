"""Each operator's query against brute force, over nulls, empty and very long texts, ties, repeated rows and clashing columns; and over empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest

from laddersmith.llm import bpe, decontaminate, html_text, license_scan, near_dup, ppm, quality, registry, suffix_dedup, token_count, toxicity

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def same(df, expected):
    """Rows as multisets."""
    assert Counter(map(tuple, df.collect())) == Counter(expected)


@pytest.mark.parametrize("name", [n for n in registry.queries() if n != "pipeline"])
def test_empty_tables(spark, empty, name):
    assert registry.queries()[name](spark, empty).count() == 0


def test_near_duplicates(spark, sf, rows):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append(frozenset(tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))) if w else frozenset())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    group = defaultdict(list)
    for i in range(len(rows)):
        group[find(i)].append(rows[i][0])
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in group[find(i)] if x is not None]
        comp = min(ids) if sets[i] and ids else d
        out.append((d, len(sets[i]), comp, d == comp))
    same(near_dup.op3_minhash_near_dup(spark, sf), out)


def test_near_duplicates_in_tiles_and_stars(spark, sf, monkeypatch):
    want = Counter(map(tuple, near_dup.op3_minhash_near_dup(spark, sf).collect()))
    monkeypatch.setattr(near_dup, "CHUNK", 2)
    monkeypatch.setattr(near_dup, "BUCKET", 1)
    assert Counter(map(tuple, near_dup.op3_minhash_near_dup(spark, sf).collect())) == want


def _repeats(rows, least):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(hashlib.blake2b(x[p : p + least], digest_size=12).digest() for x in texts for p in range(len(x) - least + 1))
    out = []
    for (d, _), x in zip(rows, texts, strict=True):
        gone = bytearray(len(x))
        for p in range(len(x) - least + 1):
            if seen[hashlib.blake2b(x[p : p + least], digest_size=12).digest()] > 1:
                gone[p : p + least] = b"\1" * least
        spans = sum(1 for i in range(len(x)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out.append((d, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
    return out


def test_repeats(spark, sf, rows, monkeypatch):
    want = _repeats(rows, 400)
    same(suffix_dedup.op6_suffix_array_dedup(spark, sf), want)
    monkeypatch.setattr(suffix_dedup, "HOT", 1)  # every open anchor by the hash of its windows
    same(suffix_dedup.op6_suffix_array_dedup(spark, sf), want)


def test_contamination(spark, sf, rows):
    from conftest import items_of  # noqa: F401  the directory's own

    def shingles(t):
        w = WORD.findall((t or "").translate(LOW))
        return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()

    items = [(i, shingles(t)) for i, t in items_of(rows)]
    out = []
    for d, t in rows:
        s = shingles(t)
        hit = [(i, len(x & s)) for i, x in items if x and 100 * len(x & s) >= 80 * len(x)]
        ids = sorted({i for i, _ in hit})
        out.append((d, bool(hit), len(ids), tuple(ids), sum(n for _, n in hit)))
    got = [(r.doc_id, r.contaminated, r.n_items, tuple(r.item_ids), r.n_common) for r in decontaminate.op9_decontaminate(spark, sf).collect()]
    assert Counter(got) == Counter(out)
    assert any(x[1] for x in out)


def test_contamination_in_blocks(spark, sf, monkeypatch):
    want = {(r.doc_id, r.contaminated, tuple(r.item_ids)) for r in decontaminate.op9_decontaminate(spark, sf).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK", 100)
    assert {(r.doc_id, r.contaminated, tuple(r.item_ids)) for r in decontaminate.op9_decontaminate(spark, sf).collect()} == want


def test_token_counts(spark, sf, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    n = [len(e.ids) for e in t.encode_batch([x or "" for _, x in rows], add_special_tokens=False)]
    same(token_count.op4_token_counts(spark, sf), [(d, len((x or "").encode()), k, k > 1024) for (d, x), k in zip(rows, n, strict=True)])


def test_bpe_round_trip(spark, sf, rows):
    import tiktoken

    path = str(P.path("byte_bpe_multi_50k.tiktoken"))
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    out = []
    for d, x in rows:
        ids = e.encode_ordinary(x or "")
        out.append((d, len(ids), sha(",".join(map(str, ids)).encode()), sha((x or "").encode())))
    same(bpe.op7_byte_bpe(spark, sf), out)
    c = bpe.Codec(bpe.build(path), P.PATTERN)
    s = "naïve 漢字 🙂 it's"
    assert [s.encode()[a:b] for a, b in c.offsets(s)] == [c.token_bytes[i] for i in c.ids(s)]
    cut = c.ids("🙂漢")
    assert b"".join(c.decode([i]) for i in cut) == "🙂漢".encode()  # characters split between tokens


def test_language_model(spark, sf, rows):
    k = ppm.ORDER
    count, tree = Counter(), [defaultdict(Counter) for _ in range(k + 1)]
    held = lambda d: None if d is None else zlib.crc32(str(d).encode()) % 7 == 2
    train = [x or "" for d, x in rows if held(d) is False]
    for x in train:
        count.update([*WORD.findall(x.translate(LOW)), None])
        b = bytes([255] * k) + x.encode() + bytes([254])
        for p in range(k, len(b)):
            for o in range(k + 1):
                tree[o][b[p - o : p]][b[p]] += 1
    total, vocab = sum(count.values()), len(count)

    def log_p(ctx, s):
        out, gone = 0.0, set()
        for o in range(k, -1, -1):
            t = tree[o].get(ctx[k - o :])
            if not t:
                continue
            live = {a: n for a, n in t.items() if a not in gone}
            n, d = sum(live.values()), len(live)
            if d:
                if s in live:
                    return out + math.log10(live[s] / (n + d))
                out += math.log10(d / (n + d))
            gone |= set(t)
        return out - math.log10(257 - len(gone))

    memo: dict = {}
    want = defaultdict(list)
    for d, x in rows:
        w = [*WORD.findall((x or "").translate(LOW)), None]
        b = bytes([255] * k) + (x or "").encode() + bytes([254])
        s = 0.0
        for p in range(k, len(b)):
            g = b[p - k : p + 1]
            if g not in memo:
                memo[g] = log_p(g[:-1], g[-1])
            s += memo[g]
        want[d].append((held(d), len(w), sum(count[i] > 0 for i in w), total, sum(math.log10((count[i] + 1) / (total + vocab + 1)) for i in w), s))
    got = defaultdict(list)
    for r in ppm.op5_ppm_lm(spark, sf).collect():
        got[r.doc_id].append(tuple(r)[1:])
    assert got.keys() == want.keys()
    for d, xs in want.items():
        for a, b in zip(sorted(xs, key=repr), sorted(got[d], key=repr), strict=True):
            assert a[:4] == b[:4]
            assert b[4:] == pytest.approx(a[4:], rel=1e-6)


def test_quality(spark, sf, rows):
    out = []
    for d, x in rows:
        x = x or ""
        w = WORD.findall(x)
        seen, dup = set(), 0
        for line in x.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        out.append((d, len(w), sum(map(len, w)), sum(x.count(s) for s in "#*$%&|<>"), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)))
    got = quality.op10_quality(spark, sf).collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter(out)
    assert not any(r.kept and r.base_failed for r in got)


def test_licenses(spark, sf, rows):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    out = []
    for d, x in rows:
        w = word.findall((x or "").translate(LOW))
        at = [(i, label) for p, label in license_scan.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        ps = [i for i, _ in at]
        out.append((d, len(w), len(ps), min(ps, default=None), max(ps, default=None), ",".join(sorted({s for _, s in at}))))
    got = license_scan.op8_license_scan(spark, sf).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(out)
    hit = [r for r in got if r.n_base]
    assert hit and all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 < r.score <= 1 for r in hit)
    assert any("cc-by-nc" in r.labels for r in hit)


def test_license_templates_by_their_notice(spark):
    t = "Header.\n" + license_scan.TEMPLATES[0][1].title() + ", and so on."
    got = license_scan.license_scan(spark.createDataFrame([(1, t), (2, "Permission is hereby granted to nobody.")], "doc_id long, text string")).collect()
    assert [(r.base_labels, r.labels) for r in sorted(got)] == [("", "mit"), ("", "")]


def test_segments_against_brute_force():
    import random

    import numpy as np

    rng = random.Random(5)

    def brute(x):
        """The best segment, then the same left and right of it."""
        best = None
        for i in range(len(x)):
            s = 0.0
            for j in range(i, len(x)):
                s += x[j]
                if s > 0 and (best is None or s > best[2] + 1e-12 or abs(s - best[2]) < 1e-12 and j + 1 - i < best[1] - best[0]):
                    best = (i, j + 1, s)
        if best is None:
            return []
        i, j, s = best
        return [*brute(x[:i]), best, *[(a + j, b + j, c) for a, b, c in brute(x[j:])]]

    for _ in range(300):
        x = np.array([rng.uniform(-2, 1.5) for _ in range(rng.randint(0, 14))])
        got = toxicity.maximal_segments(x)
        want = brute(x.tolist())
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


def test_toxicity_held_out(spark, tmp_path):
    import random

    from conftest import prose, write

    rng = random.Random(3)
    bad = ["stupid", "idiot", "scum"]
    rows, labels = [], []
    for i in range(900):
        w = prose(rng, rng.randint(20, 120)).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    sf = write(tmp_path / "tox", [*rows, (5000, None), (5001, ""), rows[0]], labels)
    got = toxicity.op1_toxicity(spark, sf).collect()
    assert len(got) == 903 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    true = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in true]
    assert sum(r.predicted == true[r.doc_id] for r in held) / len(held) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(r.predicted == 0 for r in got if r.doc_id >= 5000)


def test_html_pages(spark, sf):
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.op2_html_text(spark, sf).collect()}
    assert got == {1: ("", 0), 2: ("", 0), 3: ("plain text only", 15), 4: ("open tags two & three", 21)}


ARTICLE = "<p>" + "A long paragraph of the article with many words in it, and commas too. " * 4 + "</p><p>Second   part &eacute;tude<br>next&nbsp;line <a href=x>linked</a> words follow here for a while.</p>"


@pytest.mark.parametrize("page", [
    "<html><head><title>t</title><script>var x='<p>';</script></head><body><nav><a>menu</a></nav><article><h1>T</h1>%s</article><footer>f</footer></body></html>",
    "<body><div id=header>head</div><div class='content'><h1>T</h1>%s</div><div class='sidebar'><a href=1>one</a><a href=2>two</a></div><div id='comments'><p>first! a reader says</p></div></body>",
    "<body><header>site</header><main><h1>T</h1>%s<form><input name=q><button>go</button></form><section class='comment-list'><p>me too</p></section></main><div class='cookie-notice'>We use cookies</div></body>",
    "<body><!-- <p>no</p> --><div><div><h1>T</h1>%s<div class=ad>Buy now</div></div></div><ul><li><a href=1>x</a><li><a href=2>y</a></ul><style>p{}</style></body>",
])
def test_html_articles(page):
    want = "T " + " ".join(("A long paragraph of the article with many words in it, and commas too. " * 4).split()) + " Second part étude next line linked words follow here for a while."
    assert html_text.extract(page % ARTICLE) == want
