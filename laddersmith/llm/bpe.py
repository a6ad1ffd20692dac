"""Byte-level BPE encoding and decoding (operator 7).

The ranks of a vocabulary file become a model of the tokenizers library. A rank says which
joined bytes win; the library wants the pair that makes them. A token's pair is what the ranks
below its own leave of its bytes, so the pairs are exact and no others can arise.

Text is cut by the pattern; each distinct piece of a task is encoded once, by the library, over
the byte-to-character table, and kept in a bounded cache. Token offsets in bytes follow from the tokens' lengths.
Decoding reverses the byte table; characters that are split between tokens come back whole because bytes, not characters, are joined.

Defined results: null or empty texts have no tokens (the digests are those of no bytes); repeated rows
are encoded alike; extra columns are ignored; an empty table gives an empty result. A run without a break
(one very long piece) is encoded as one piece, like any other.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laddersmith.llm.common import read

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces that a worker keeps, and the longest that it keeps.
CACHE, LONGEST = 200_000, 64


def byte_table() -> list[str]:
    """The character that stands for each byte: printable Latin-1 stays, the others follow from U+0100 on."""
    stays = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 256
    for b in range(256):
        if b in stays:
            out[b] = chr(b)
        else:
            out[b] = chr(n)
            n += 1
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(parts: list[bytes], ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Joins the pair of least rank, the leftmost first, until none is left (below a rank, if given)."""
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (below is None or r < below) and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
    return parts


def build(path: str) -> str:
    """The library's JSON of a vocabulary of ranks."""
    from tokenizers import Tokenizer
    from tokenizers.models import BPE

    ranks = read_ranks(path)
    table = byte_table()
    text = {t: "".join(table[b] for b in t) for t in ranks}
    pairs = []
    for t, r in sorted(ranks.items(), key=lambda x: x[1]):
        if len(t) > 1:
            two = merge([t[i : i + 1] for i in range(len(t))], ranks, r)
            if len(two) == 2:
                pairs.append((text[two[0]], text[two[1]]))
    # a whole piece that is in the vocabulary is one token, even if no pairs lead to it
    return Tokenizer(BPE(vocab={text[t]: r for t, r in ranks.items()}, merges=pairs, ignore_merges=True)).to_str()


_KEPT: dict[str, Codec] = {}


class Codec:
    """Encodes pieces with the library and remembers them."""

    def __init__(self, spec: str, pattern: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(spec)
        self.find = regex.compile(pattern).findall
        self.table = byte_table()
        back = {c: b for b, c in enumerate(self.table)}
        vocab = self.model.get_vocab(with_added_tokens=False)
        self.token_bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.known: dict[str, tuple[str, int, bytes]] = {}

    @staticmethod
    def of(spec: str, pattern: str) -> Codec:
        """One for each worker process."""
        key = hashlib.sha256((pattern + spec).encode()).hexdigest()
        if key not in _KEPT:
            _KEPT.clear()
            _KEPT[key] = Codec(spec, pattern)
        return _KEPT[key]

    def piece(self, s: str) -> tuple[str, int, bytes]:
        """Ids joined by commas, how many, and the bytes that they decode to."""
        ids = [t.id for t in self.model.model.tokenize("".join(self.table[b] for b in s.encode()))]
        return ",".join(map(str, ids)), len(ids), b"".join(self.token_bytes[i] for i in ids)

    def text(self, s: str) -> tuple[str, int, bytes]:
        pieces = self.find(s)
        known = self.known
        got = list(map(known.get, pieces))
        if None in got:
            if len(known) > CACHE:
                known.clear()
            for i, g in enumerate(got):
                if g is None:
                    p = pieces[i]
                    g = known.get(p)
                    if g is None:
                        g = self.piece(p)
                        if len(p) <= LONGEST:
                            known[p] = g
                    got[i] = g
        if not got:
            return "", 0, b""
        ids, n, raw = zip(*got, strict=True)
        return ",".join(ids), sum(n), b"".join(raw)

    def ids(self, s: str) -> list[int]:
        x = self.text(s)[0]
        return [int(i) for i in x.split(",")] if x else []

    def offsets(self, s: str) -> list[tuple[int, int]]:
        """Start and end of each token, in bytes."""
        ends = np.cumsum([len(self.token_bytes[i]) for i in self.ids(s)])
        return list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)) if len(ends) else []

    def decode(self, ids: list[int]) -> bytes:
        """The ids' bytes; a sequence cut inside a character ends with part of it."""
        return b"".join(self.token_bytes[i] for i in ids)


def encode(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, n_tokens, ids_sha256, decoded_sha256), and with ``ids`` the ids."""
    spec = docs.sparkSession.sparkContext.broadcast(build(path))

    def run(batches):
        c = Codec.of(spec.value, pattern)
        for b in batches:
            n, h1, h2, seqs = [], [], [], []
            for s in b.column(1):
                x, k, raw = c.text(s.as_py() or "")
                n.append(k)
                h1.append(hashlib.sha256(x.encode()).hexdigest())
                h2.append(hashlib.sha256(raw).hexdigest())
                if ids:
                    seqs.append([int(i) for i in x.split(",")] if x else [])
            cols = [b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(h1), pa.array(h2)] + ([pa.array(seqs, pa.list_(pa.int64()))] if ids else [])
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids)
        c.known.clear()  # workers live on; what they keep shouldn't stand beside the next stage

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * ids)


def op7_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """Encodes and decodes whole ``documents``."""
    import public_tokenizers

    return encode(read(spark, sf_dir, "documents", "doc_id", "text"), str(public_tokenizers.path(vocabulary)), public_tokenizers.PATTERN)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: each row's doc_id, token ids, their number, and the digests of the round trip; other columns end here.

    Null and empty texts have no ids; repeated rows are encoded alike; an empty table gives an empty result.
    """
    import public_tokenizers

    return encode(docs, str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN, ids=True)
