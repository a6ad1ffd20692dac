"""Language-model scores by prediction by partial matching (operator 5).

The model is a byte trie of order ORDER: the counts of every (ORDER + 1)-byte string of the training texts, with
FIRST bytes before a text and one END behind it. A byte that its context has not seen escapes to
the next shorter context with probability d / (n + d) (method C: d different successors in n places);
successors that the longer context has seen are excluded from the shorter one's counts; below order 0 all
symbols left are alike. Code lengths are pretrained: a text's log10 probability is the sum over its strings.

Plan. One pass over the documents packs them into blocks and lists, for each block, its distinct
byte strings and words with their counts in training texts (sorted strings are the trie's paths; no row per position). The lists are cut by
bucket, so that a bucket has all suffix contexts of its strings (they share the two bytes before the last), and packed. They are merged
bucket by bucket in rounds of FAN partitions' lists a task, so that a frequent bucket's task holds FAN lists however many there are; the last round has the corpus's
counts, which grow with it, and turns them into code lengths: the model, one row a bucket. Each bucket's row then meets the lists, again FAN partitions' at a time, and sends each block its values
in the order of its list; the tables of orders 0 and 1 have at most 65,792 cells and are broadcast. Each block lists its strings
again, takes the values and is scored by walking its own strings. Long texts are cut into runs of CHUNK bytes that overlap by ORDER; what a task
holds at a time is a block (a whole text at least), a bucket's model, or FAN partitions' lists of one bucket.

Words are keyed by 64-bit hashes.

Defined results: null or empty texts are scored as an end alone; without training texts N and V are 0 and the
trie is empty, so every symbol costs log10(257); code lengths are kept as 32-bit floats; repeated rows each count and are scored alike; rows without id have no fold
and are scored but not learned from; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laddersmith.llm import words as W
from laddersmith.llm.common import by_group, fold, materialize, parallelism, read

ORDER = 5
#: Bytes that never occur in UTF-8 stand for the start and the end of a text.
FIRST, END = 0xFF, 0xFE
#: Symbols that may follow a context: all bytes and the end.
SYMBOLS = 257
#: Bytes of text in a block.
BLOCK = 16 << 20
U = np.uint64
#: The end's key among words.
END_WORD = (1 << 64) - 1
#: Bytes of text whose strings are sorted together.
CHUNK = 1 << 20
#: Partitions whose lists of a bucket are merged in one task.
FAN = 64
#: Listed strings that are held before they are merged.
HELD = 1 << 20


def strings(col: pa.Array):
    """By runs of about CHUNK bytes: (first row, first symbol of each of its rows, the string of each symbol).

    A text is framed as FIRST * ORDER + bytes + END; a string is ORDER bytes and the symbol behind them, as an integer.
    A text longer than CHUNK comes in several runs.
    """
    for i, j, raw, offs in W.chunks(col, CHUNK):
        if j - i > 1 or len(raw) <= CHUNK:
            yield i, *framed(raw, offs)
            continue
        for a in range(0, len(raw), CHUNK):
            head = raw[a - ORDER : a] if a else np.full(ORDER, FIRST, np.uint8)
            tail = np.full(int(a + CHUNK >= len(raw)), END, np.uint8)
            x = np.concatenate([head, raw[a : a + CHUNK], tail])
            yield i, np.array([0, len(x) - ORDER]), _six(x, np.arange(len(x) - ORDER))


def _six(x: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The ORDER + 1 bytes from each place on."""
    return W.eights(x).view(np.dtype(">u8"))[place].astype(U) >> U(64 - 8 * (ORDER + 1))


def framed(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First symbol of each row, and the string of each symbol (a row's bytes and its end)."""
    n = len(offs) - 1
    first = offs + np.arange(n + 1)
    out = np.full(len(buf) + n * (ORDER + 1), FIRST, np.uint8)
    place = np.empty(len(buf) + n, np.int64)
    at = 0
    for r, (i, j) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
        out[at + ORDER : at + ORDER + j - i] = buf[i:j]
        out[at + ORDER + j - i] = END
        place[i + r : j + r + 1] = np.arange(at, at + j - i + 1)
        at += j - i + ORDER + 1
    return first, _six(out, place)


def _words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wh, _, _, first = W.word_hashes(W.LOWER[raw], offs, W.SPACE)
    return wh, first


def _buckets(kind: int, keys: np.ndarray, n: int) -> np.ndarray:
    """Words by hash; strings by the two bytes before the last."""
    return (W.mix(keys if kind == 0 else (keys >> U(8)) & U(0xFFFF)) % U(n)).astype(np.int64)


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _planes(x: np.ndarray) -> np.ndarray:
    """Bytes of the first differences, least significant first: sorted keys compress well so."""
    d = np.diff(x, prepend=U(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T)


def _from_planes(b: bytes) -> np.ndarray:
    d = np.ascontiguousarray(_unpack(b, np.uint8).reshape(8, -1).T).view(U).ravel()
    return np.cumsum(d, dtype=U)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of several lists, and their summed counts."""
    if not parts:
        return np.zeros(0, U), np.zeros(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    k, n = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    o = np.argsort(k)
    return _summed(k[o], n[o])


def _summed(k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a sorted array, and the sums of what belongs to each."""
    if not len(k):
        return k, n.astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[at], np.add.reduceat(n, at, dtype=np.int64)


class _Lists:
    """Lists that are merged whenever too many keys are held."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, n))
        self.size += len(keys)
        if self.size > HELD and len(self.parts) > 1:
            self.parts = [_merged(self.parts)]
            self.size = 0  # so many new ones before the next time

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        return _merged(self.parts)


def listing(col: pa.Array, train: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """What a block lists: for words (0) and strings (1), sorted distinct keys and their counts in training rows."""
    words, trie = _Lists(), _Lists()
    words.add(np.array([END_WORD], U), np.array([train.sum()]))
    for i, j, raw, offs in W.chunks(col, CHUNK):
        wh, first = _words(raw, offs)
        u, inv = np.unique(wh, return_inverse=True)
        words.add(u, np.bincount(inv[np.repeat(train[i:j], np.diff(first))], minlength=len(u)))
    for i, first, k in strings(col):
        own = np.repeat(train[i : i + len(first) - 1], np.diff(first))
        k = np.sort((k << U(1)) | own.astype(U))  # whether a string is of a training row is its lowest bit
        trie.add(*_summed(k >> U(1), (k & U(1)).astype(np.int64)))
    return {0: words.all(), 1: trie.all()}


def blocks(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Rows of blocks: kind 0 and 1, packed keys and counts of a bucket; 2, the texts; 3, cells of the order-1 table; 4, training tokens."""

    def run(batches):
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        held, size = [], 0
        names = ["block", "kind", "bucket", "key", "n", "payload"]

        def rows(block, kind, bucket, key, n, payload):
            m = len(bucket)
            return pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), pa.array(np.full(m, kind, np.int32)), pa.array(bucket, pa.int64()), pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(payload, pa.binary())], names=names)

        def flush():
            nonlocal nth, held, size
            t = pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
            block = (part << 24) | nth
            nth += 1
            train = ~t.column(2).combine_chunks().fill_null(True).to_numpy(zero_copy_only=False).astype(bool)
            found = listing(t.column(1).combine_chunks(), train)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema) as w:
                w.write_table(t)
            yield rows(block, 2, [0], [0], [0], [zstandard.ZstdCompressor(level=1).compress(sink.getvalue())])
            yield rows(block, 4, [0], [0], [int(found[0][1].sum())], [None])
            keys, n = found[1]
            low = np.bincount((keys & U(0xFFFF)).astype(np.int64), n, 1 << 16).astype(np.int64)
            cell = np.flatnonzero(low)
            yield rows(block, 3, np.zeros(len(cell), np.int64), cell, low[cell], [None] * len(cell))
            for kind, (keys, n) in found.items():
                b = _buckets(kind, keys, n_buckets)
                o = np.argsort(b, kind="stable")
                cut = np.searchsorted(b[o], np.arange(n_buckets + 1))
                full = np.flatnonzero(np.diff(cut))
                packed = []
                for i in full.tolist():
                    mine = o[cut[i] : cut[i + 1]]
                    packed.append(_packed(keys[mine], n[mine].astype(np.int64)))
                yield rows(block, kind, full, np.zeros(len(full), np.int64), cut[full + 1] - cut[full], packed)

        for b in batches:
            for i, j, raw, _ in W.chunks(b.column(1), BLOCK // 8):
                held.append(b.slice(i, j - i))
                size += len(raw)
                if size >= BLOCK:
                    yield from flush()
        if held:
            yield from flush()

    return docs.mapInArrow(run, "block long, kind int, bucket long, key long, n long, payload binary")


def log_probabilities(keys: np.ndarray, n: np.ndarray, low: np.ndarray) -> np.ndarray:
    """log10 probability of each string's last byte after its others.

    ``keys`` and ``n``: all strings, with their training counts (0 if only asked for), that share the two bytes before
    the last; ``low``: counts [context byte, symbol] of order 1 over all training texts.
    """
    ctx, sym = keys >> U(8), (keys & U(255)).astype(np.int64)
    out = np.zeros(len(keys))
    todo = np.arange(len(keys))  # not coded yet
    above: np.ndarray | None = None  # for each one: the symbols its longer context excludes
    seen = n > 0
    for order in range(ORDER, -1, -1):
        if not len(todo):
            return out
        if order > 1:
            c = ctx & U((1 << (8 * order)) - 1)
            known = W.distinct(c[seen])
            if len(known):
                pair, inv = np.unique((c[seen] << U(8)) | sym[seen].astype(U), return_inverse=True)
                count = np.bincount(inv, n[seen])
                ctx_of, sym_of = pair >> U(8), (pair & U(255)).astype(np.int64)
                first = np.searchsorted(ctx_of, known)
                first = np.append(first, len(pair))
            own = c[todo]
            at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0)) if len(known) else np.zeros(len(own), np.int64)
            ok = known[at] == own if len(known) else np.zeros(len(own), bool)
            row = lambda k: (sym_of[first[k] : first[k + 1]], count[first[k] : first[k + 1]])
        else:
            b = (ctx[todo] & U(255)).astype(np.int64)
            table = low if order else low.sum(axis=0, keepdims=True)
            at = b if order else np.zeros(len(todo), np.int64)
            ok = table.sum(axis=1)[at] > 0
            row = lambda k: (np.flatnonzero(table[k]), table[k][table[k] > 0])
        left, masks = [], {}
        # those with the same context here and the same exclusions are coded together
        group = np.where(ok, at + 1, 0)
        key = group * (1 << 32) + (above if above is not None else 0)
        gk, ginv = np.unique(key, return_inverse=True)
        where = np.argsort(ginv, kind="stable")
        cuts = np.searchsorted(ginv[where], np.arange(len(gk) + 1))
        next_above = np.zeros(len(todo), np.int64)
        for g, k in enumerate(gk.tolist()):
            mine = where[cuts[g] : cuts[g + 1]]
            prev = k & 0xFFFFFFFF
            node = (k >> 32) - 1
            gone = _MASKS.get(prev)
            if node < 0:  # a context that training hasn't seen costs nothing and excludes nothing
                next_above[mine] = prev
                left.append(mine)
                continue
            s, m = row(node)
            full = np.zeros(256)
            full[s] = m
            mask = np.zeros(256, bool)
            mask[s] = True
            if gone is not None:
                full[gone] = 0
            total, d = full.sum(), np.count_nonzero(full)
            if d == 0:
                next_above[mine] = _mask_id(mask if gone is None else mask | gone)
                left.append(mine)
                continue
            hit = full[sym[todo[mine]]]
            yes = hit > 0
            out[todo[mine[yes]]] += np.log10(hit[yes] / (total + d))
            rest = mine[~yes]
            if len(rest):
                out[todo[rest]] += math.log10(d / (total + d))
                next_above[rest] = _mask_id(mask if gone is None else mask | gone)
                left.append(rest)
        left = np.concatenate(left) if left else np.zeros(0, np.int64)
        todo, above = todo[left], next_above[left]
    for k in np.unique(above) if len(todo) else []:
        gone = _MASKS.get(int(k))
        mine = todo[above == k]
        out[mine] -= math.log10(SYMBOLS - (0 if gone is None else int(gone.sum())))
    return out


#: Sets of excluded symbols, by number; cleared for each group.
_MASKS: dict[int, np.ndarray] = {}
_NUMBERS: dict[bytes, int] = {}


def _mask_id(mask: np.ndarray) -> int:
    b = mask.tobytes()
    k = _NUMBERS.get(b)
    if k is None:
        k = _NUMBERS[b] = len(_NUMBERS) + 1
        _MASKS[k] = mask
    return k


def _packed(keys: np.ndarray, n: np.ndarray) -> bytes:
    a = _pack(_planes(keys))
    return len(a).to_bytes(4, "little") + a + _pack(n)


def _unpacked(x: bytes, kind=np.int64) -> tuple[np.ndarray, np.ndarray]:
    m = int.from_bytes(x[:4], "little")
    return _from_planes(x[4 : 4 + m]), _unpack(x[4 + m :], kind)


_LISTS = "kind int, bucket long, part long, payload binary"


def _rows(kind, bucket, part, payload) -> pa.Table:
    return pa.table({"kind": pa.array(kind, pa.int32()), "bucket": pa.array(bucket, pa.int64()), "part": pa.array(part, pa.int64()), "payload": pa.array(payload, pa.binary())})


def model(lists: DataFrame, parts: int, n_buckets: int, low: np.ndarray) -> DataFrame:
    """(kind, bucket, part, payload): for each bucket the packed keys and code lengths of its strings (kind 1), counts of its words (kind 0),
    and how many words training has (kind 5, in ``part``). ``lists`` has the same columns, by block; ``parts``: its partitions' number."""

    def merge(last: bool):
        def run(_, t: pa.Table):
            kind, bucket, part = t["kind"].to_numpy(), int(t["bucket"][0].as_py()), int(t["part"][0].as_py())
            out: list[tuple[int, int, bytes]] = []
            for k in (0, 1):
                held = _Lists()
                for i in np.flatnonzero(kind == k).tolist():
                    held.add(*_unpacked(t["payload"][i].as_py()))
                keys, n = held.all()
                if not len(keys):
                    continue
                if last and k:
                    _MASKS.clear()
                    _NUMBERS.clear()
                    n = log_probabilities(keys, n, low).astype(np.float32)
                elif last:
                    out.append((5, int((n > 0).sum()), b""))
                out.append((k, 0 if last else part // FAN, _packed(keys, n)))
            return _rows([x[0] for x in out], [bucket] * len(out), [x[1] for x in out], [x[2] for x in out])

        return run

    while True:
        parts = -(-parts // FAN)
        keyed = lists.withColumn("_g", F.col("bucket") * parts + F.floor(F.col("part") / FAN))
        lists = materialize(by_group(keyed, "_g", merge(parts == 1), _LISTS, ["kind", "part"], n_buckets * min(parts, FAN)), "lm-merged")
        if parts == 1:
            return lists


def lm_scores(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, held_out) to the columns of op5."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("held_out").cast("boolean").alias("held_out"))
    n_parts = docs.rdd.getNumPartitions()
    n_buckets = max(parallelism(docs.sparkSession), n_parts)
    listed = materialize(blocks(docs, n_buckets), "lm-blocks")
    low = np.zeros((256, 256))
    for r in listed.where("kind = 3").groupBy("key").agg(F.sum("n").alias("n")).collect():  # 65,536 cells at most
        low[r.key >> 8, r.key & 255] = r.n
    n_train = int(listed.where("kind = 4").agg(F.sum("n")).head()[0] or 0)

    part = F.shiftright("block", 24)
    lists = listed.where("kind < 2").select("kind", "bucket", part.alias("part"), "payload")
    lengths = model(lists, n_parts, n_buckets, low)
    vocabulary = int(lengths.where("kind = 5").agg(F.sum("part")).head()[0] or 0)
    denominator = n_train + vocabulary + 1

    # a bucket's model meets the lists of FAN partitions at a time
    groups = -(-n_parts // FAN)
    asks = listed.where("kind < 2").select("kind", "bucket", F.floor(part / FAN).alias("g"), "block", "payload")
    told = lengths.where("kind < 2").select("kind", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), F.lit(-1).cast("long").alias("block"), "payload")
    keyed = asks.unionByName(told).select((F.col("bucket") * groups + F.col("g")).alias("_g"), "kind", "bucket", "block", "payload")

    def answer(_, t: pa.Table):
        kind, block = t["kind"].to_numpy(), t["block"].to_numpy()
        out: list[tuple[int, int, bytes]] = []
        for k in (0, 1):
            mine = np.flatnonzero(kind == k).tolist()
            if not mine:
                continue
            keys, value = _unpacked(t["payload"][mine[0]].as_py(), np.float32 if k else np.int64)  # the model's row comes first
            for i in mine[1:]:
                out.append((int(block[i]), k, _pack(value[np.searchsorted(keys, _unpacked(t["payload"][i].as_py())[0])])))
        return pa.table({"block": pa.array([x[0] for x in out], pa.int64()), "kind": pa.array([x[1] for x in out], pa.int32()), "bucket": pa.array([t["bucket"][0].as_py()] * len(out), pa.int64()), "payload": pa.array([x[2] for x in out], pa.binary())})

    values = materialize(by_group(keyed, "_g", answer, "block long, kind int, bucket long, payload binary", ["kind", "block"], n_buckets * min(groups, FAN)), "lm-values")

    def score(_, t: pa.Table):
        kind = t["kind"].to_numpy()
        mine = [np.flatnonzero(kind == k).tolist() for k in (0, 1, 2)]
        value = [np.concatenate([_unpack(t["payload"][i].as_py(), np.float32 if k else np.int64) for i in mine[k]] or [np.zeros(0)]) for k in (0, 1)]
        packed = t["payload"][mine[2][0]].as_py()
        del t
        docs = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(packed)).read_all()
        del packed
        col = docs.column(1).combine_chunks()
        docs = docs.select([0, 2])
        n = len(col)

        def in_order(keys: np.ndarray, k: int) -> np.ndarray:
            out = np.empty(len(keys), value[k].dtype)
            out[np.argsort(_buckets(k, keys, n_buckets), kind="stable")] = value[k]  # the order of the list: by bucket, then by key
            return out

        found = [(i, *_words(raw, offs)) for i, _, raw, offs in W.chunks(col, CHUNK)]
        keys = W.distinct(np.concatenate([np.array([END_WORD], U), *[h for _, h, _ in found]]))
        count = in_order(keys, 0)
        cost = np.log10((count + 1) / denominator)
        end = np.searchsorted(keys, U(END_WORD))
        n_tokens, n_known, base = np.ones(n, np.int64), np.full(n, int(count[end] > 0)), np.full(n, cost[end])
        for i, h, first in found:
            at, r = np.searchsorted(keys, h), slice(i, i + len(first) - 1)
            n_tokens[r] += np.diff(first)
            n_known[r] += _sums((count[at] > 0).astype(float), first).astype(np.int64)
            base[r] += _sums(cost[at], first)
        del found, keys, count, cost
        # the strings are sorted a second time rather than held, with their places, all at once
        keys = np.zeros(0, U)
        for _, _, s in strings(col):
            keys = W.distinct(np.concatenate([keys, W.distinct(s)]))
        length = in_order(keys, 1)
        lm = np.zeros(n)
        for i, first, s in strings(col):
            u, inv = np.unique(s, return_inverse=True)
            lm[i : i + len(first) - 1] += _sums(length[np.searchsorted(keys, u)].astype(float)[inv], first)
        return pa.table({"doc_id": docs.column(0), "held_out": docs.column(1), "n_tokens": n_tokens, "n_known": n_known, "base_score": base, "score": lm})

    texts = listed.where("kind = 2").select("block", "kind", "bucket", "payload")
    rows = texts.unionByName(values)
    # a partition has few blocks: each has a task to itself, or nearly
    spread = 4 * n_parts
    task = F.pmod(4 * part + F.col("block").bitwiseAND(3), F.lit(spread)).cast("int")
    out = by_group(rows, "block", score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double", ["kind", "bucket"], spread, task)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of x by row, each row on its own (no running total over rows)."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return np.bincount(row, x, len(first) - 1)


def op5_ppm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of whole ``documents``, learned from those outside the held-out fold."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return lm_scores(docs.withColumn("held_out", fold("doc_id", 7) == 2))
