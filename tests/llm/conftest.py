import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

WORDS = "the and of quick brown fox jumps over lazy dog sie und der die das étude naïve straße año señor 中文 العربية data model corpus token text page line".split()


def prose(rng, n, words=WORDS):
    out = []
    while len(out) < n:
        k = rng.randint(4, 14)
        s = [rng.choice(words) + (rng.choice(words) if rng.random() < 0.5 else "") for _ in range(k)]
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
    return " ".join(out[:n])


def corpus():
    """Documents with nulls, empty and odd texts, copies, near copies, shared passages, repeated rows and one very long text."""
    rng = random.Random(7)
    base = [prose(rng, rng.randint(30, 200)) for _ in range(24)]
    docs = list(base)
    docs += [base[0], base[0], base[1].upper()]  # copies
    for i in range(6):  # near copies
        w = base[2].split()
        w[rng.randrange(len(w))] = f"changed{i}"
        docs.append(" ".join(w))
    passage = prose(rng, 120)
    docs += [prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 30) for _ in range(3)]
    docs += [None, "", "   \n\t ", "one", "one", "two words", "You IDIOT moron clown", "x" * 5000, "ab" * 2500, "\0 nul \x7f", "🙂 👩‍👩‍👧 <|endoftext|> é", "Released under the MIT License.\nSee CC BY-NC 4.0. Licensed under CC BY NC 4.0.\n"]
    docs += [prose(rng, 30000)]
    docs += ["line a\nline a\n\nline b\nline a\n" + "same eight words stand here again and again " * 5]
    rows = [(i * 3 + 1, t) for i, t in enumerate(docs)]
    rows += [rows[3], rows[3], (None, "a text without an id stands here")]
    rng.shuffle(rows)
    return rows


def write(path, rows, labels=(), items=(), pages=()):
    path.mkdir(parents=True, exist_ok=True)
    ids, texts = [r[0] for r in rows], [r[1] for r in rows]
    clash = {c: pa.array(["x"] * len(rows), pa.string()) for c in ("key", "node", "label", "region", "text_kept", "score", "spans", "matches", "_key", "block")}
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array([("en", "de", None)[(i or 0) % 3] for i in ids], pa.string()), "source": pa.array(["s"] * len(rows), pa.string()), "n_chars": pa.array([len(t or "") for t in texts], pa.int64()), **clash}), path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([1] * len(labels), pa.int32()), "toxic": pa.array([x[1] for x in labels], pa.int32())}), path / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([x[0] for x in items], pa.int64()), "text": pa.array([x[1] for x in items], pa.string())}), path / "benchmark.parquet")
    pq.write_table(pa.table({"page_id": pa.array([x[0] for x in pages], pa.int64()), "url": pa.array(["u"] * len(pages), pa.string()), "html": pa.array([x[1] for x in pages], pa.string())}), path / "pages.parquet")
    return str(path)


def items_of(rows):
    texts = [t for _, t in rows if t and len(t) > 300]
    return [(1, " ".join(texts[0].split()[5:30])), (2, "no document has this sentence of plainly other words at all"), (3, None), (4, ""), (5, "one"), (5, " ".join(texts[1].split()[2:40])), (6, " ".join(texts[-1].split()[:20]) + " and five more words here")]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def sf(tmp_path_factory, rows):
    labels = [(i, int(bool(t) and "IDIOT" in t)) for i, t in rows if i is not None] + [(None, 1), (1, None)]
    pages = [(1, None), (2, ""), (3, "plain text only"), (4, "<p>open <b>tags <p>two &amp; three")]
    return write(tmp_path_factory.mktemp("sf") / "x", rows, labels, items_of(rows), pages)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("sf") / "empty", [])
