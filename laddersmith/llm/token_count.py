"""Token counts by rank-synchronous merging of arrays (operator 4).

The distinct pre-tokens of a run of texts become one ragged array of symbols. Each round finds
every sequence's pair of least rank and applies it at all its places in all sequences at once;
only pairs next to a merge are looked up again. Sequences without a pair leave with the number of their surviving symbols.

Joining all places of the least pair together is what one merge after the other does: a pair with
the new symbol always ranks behind the pair that made it. Where places overlap (a run of one symbol), every second counts, from the left.

Defined results: null or empty texts have 0 bytes and 0 tokens; special strings count one token each, as the library's default has it;
repeated rows are counted alike; extra columns are ignored; an empty table gives an empty result. A
pre-token may be of any length.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laddersmith.llm.bpe import byte_table
from laddersmith.llm.common import read

#: The pattern of byte-level pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE, LONGEST = 300_000, 64
#: Characters of text whose pre-tokens are merged together.
RUN = 1 << 20
_NONE = np.iinfo(np.int32).max


class Counter:
    """Counts the tokens of texts under a byte-level BPE vocabulary (the library's JSON)."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        vocab, table = j["model"]["vocab"], byte_table()
        self.start = np.array([vocab[c] for c in table], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in j["model"]["merges"]]
        a = np.array([vocab[x] for x, _ in pairs], np.int64)
        b = np.array([vocab[y] for _, y in pairs], np.int64)
        key = (a << 20) | b
        o = np.argsort(key)
        self.key, self.rank, self.made = key[o], o.astype(np.int32), np.array([vocab[x + y] for x, y in pairs], np.int64)[o]
        special = [t["content"] for t in j.get("added_tokens") or [] if t.get("content")]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.find = regex.compile(PATTERN).findall
        self.known: dict[str, int] = {}

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of pairs."""
        k = (a << 20) | b
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        return np.where(self.key[at] == k, self.rank[at], _NONE).astype(np.int32), self.made[at]

    def merge(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols that survive in each piece."""
        out = np.zeros(len(pieces), np.int64)
        size = np.array([len(p) for p in pieces], np.int64)
        sym = self.start[np.frombuffer(b"".join(pieces), np.uint8)]
        who = np.flatnonzero(size)
        size = size[who]
        while len(who):
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            last = first + size - 1
            rank, made = np.full(len(sym), _NONE, np.int32), np.zeros(len(sym), np.int64)
            rank[:-1], made[:-1] = self._look(sym[:-1], sym[1:])
            rank[last] = _NONE
            while True:  # rounds, until half of the sequences are done
                low = np.minimum.reduceat(rank, first)
                live = low < _NONE
                if 2 * live.sum() <= len(live):
                    break
                hit = (rank == np.repeat(low, size)) & (rank < _NONE)
                at = np.flatnonzero(hit)
                run = np.concatenate([[True], at[1:] != at[:-1] + 1])
                nth = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[nth % 2 == 0]
                sym[at] = made[at]
                gone = np.zeros(len(sym), bool)
                gone[at + 1] = True
                place = np.cumsum(~gone) - 1
                size = size - np.add.reduceat(gone.astype(np.int64), first)
                keep = ~gone
                sym, rank, made = sym[keep], rank[keep], made[keep]
                first = np.concatenate([[0], np.cumsum(size)[:-1]])
                last = first + size - 1
                at = place[at]
                fresh = np.unique(np.concatenate([at, at[at > 0] - 1]))
                fresh = fresh[fresh + 1 < len(sym)]
                rank[fresh], made[fresh] = self._look(sym[fresh], sym[fresh + 1])
                rank[last] = _NONE
            out[who[~live]] = size[~live]
            sym = sym[np.repeat(live, size)]
            who, size = who[live], size[live]
        return out

    def counts(self, texts: list[str]) -> list[int]:
        known, found, extra = self.known, [], []
        for s in texts:
            if self.special is not None and self.special.search(s):
                parts = self.special.split(s)
                extra.append(len(parts) - 1)
                found.append([p for part in parts for p in self.find(part)])
            else:
                extra.append(0)
                found.append(self.find(s))
        new = list({p for pieces in found for p in pieces if p not in known})
        if new:
            if len(known) + len(new) > CACHE:
                known.clear()
                new = list({p for pieces in found for p in pieces})
            known.update(zip(new, self.merge([p.encode() for p in new]).tolist(), strict=True))
        out = [sum(map(known.__getitem__, pieces)) + x for pieces, x in zip(found, extra, strict=True)]
        for p in new:
            if len(p) > LONGEST:
                del known[p]
        return out


_KEPT: dict[str, Counter] = {}


def _counter(spec: str) -> Counter:
    key = str(hash(spec))
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Counter(spec)
    return _KEPT[key]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, n_bytes, n_tokens)."""
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        c = _counter(spec.value)
        for b in batches:
            size, count, held, n = [], [], [], 0
            for s in b.column(1):
                x = s.as_py() or ""
                size.append(len(x.encode()))
                held.append(x)
                n += len(x)
                if n >= RUN:
                    count += c.counts(held)
                    held, n = [], 0
            count += c.counts(held)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(count, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])
        c.known.clear()  # workers live on; what they keep shouldn't stand beside the next stage

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """Tokens of whole ``documents``, and whether they pass a limit."""
    import public_tokenizers

    out = token_counts(read(spark, sf_dir, "documents", "doc_id", "text"), str(public_tokenizers.path(vocabulary)))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
