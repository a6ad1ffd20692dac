"""Chat formatting (operator 13).

Each turn is a segment of its own: the id that opens its role, the ids of its text, the id that closes it. Texts are encoded alone, so
no merge crosses a mark, and marks are reserved ids behind the vocabulary's own, spliced in. Control strings inside texts get a
backslash behind their first character (one that is written with backslashes gets one more), so no text can be read as a mark, nor any text
be lost: ``unescape`` takes it out again. Running sums over a conversation's turns give each segment its place; the loss mask is the running sum of
+1 where a text to be learned begins and -1 where it ends.

The output is a row for each turn, in order: a conversation of any length is its segments one behind the other, and no row or task holds it whole.

Defined results: rows go by conversation and turn (null first), rows that tie by role and text; rows that repeat are turns. A null text or role is empty;
a role without a mark of its own is written out between two marks. Rows with a null conversation id are one conversation.
Very long texts are encoded in whole; extra columns take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laddersmith.llm.common import parallelism, read, ship

# Spark has a task on every core already
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The control strings: the begin of a conversation, the marks of roles, and what closes a turn.
BEGIN, WRITTEN_ROLE, TEXT, END_TURN, END_LEARNED = "<s>", "[ROLE]", "[TEXT]", "[/INST]", "</s>"
ROLE_MARKS = {"system": "[SYS]", "user": "[INST]", "assistant": "[OUT]", "tool": "[TOOL]"}
LEARNED = ("assistant",)
#: Characters of text that are encoded together.
RUN = 1 << 20


class Escape:
    """Reversible escapes: a control string c + rest stands in texts as c + backslash + rest."""

    def __init__(self, controls: list[str]):
        if any(len(c) < 2 or c[0] in c[1:] or "\\" in c or c[0] in {d[i] for d in controls for i in range(1, len(d))} for c in controls):
            raise ValueError("a control string's first character must stand in none of them again")
        parts = sorted(set(controls), key=len, reverse=True)
        either = "|".join(f"{regex.escape(c[0])}(?=\\\\*{regex.escape(c[1:])})" for c in parts)
        self.write = regex.compile(either)
        back = "|".join(f"(?<={regex.escape(c[0])})\\\\(?=\\\\*{regex.escape(c[1:])})" for c in parts)
        self.read = regex.compile(back)

    def escape(self, s: str) -> str:
        return self.write.sub(lambda m: m.group() + "\\", s)

    def unescape(self, s: str) -> str:
        return self.read.sub("", s)


class Template:
    """Marks as reserved ids behind a byte-level vocabulary of the tokenizers library."""

    def __init__(self, spec: str, role_marks: dict[str, str], learned: tuple[str, ...]):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(spec)
        self.model.no_truncation()
        self.model.no_padding()
        self.marks = role_marks
        self.learned = set(learned)
        names = [BEGIN, WRITTEN_ROLE, TEXT, END_TURN, END_LEARNED, *self.marks.values()]
        special = [t["content"] for t in json.loads(spec).get("added_tokens") or [] if t.get("content")]
        self.escapes = Escape([*names, *special])
        first = self.model.get_vocab_size(with_added_tokens=True)
        self.ids = {c: first + i for i, c in enumerate(names)}
        self.names = {i: c for c, i in self.ids.items()}
        self.first = first
        #: How ids travel between tasks: packed, two bytes each where the vocabulary allows it.
        self.packed = np.uint16 if first + len(names) <= 1 << 16 else np.int32

    def opening(self, role: str) -> list[str]:
        """What stands before a turn's text: marks and texts by turns."""
        return [self.marks[role]] if role in self.marks else [WRITTEN_ROLE, role, TEXT]

    def closing(self, role: str) -> str:
        return END_LEARNED if role in self.learned else END_TURN

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch([self.escapes.escape(t) for t in texts], add_special_tokens=False)]

    def text(self, ids: list[int]) -> str:
        """What a segment without marks says, unescaped."""
        return self.escapes.unescape(self.model.decode(ids, skip_special_tokens=False)) if ids else ""

    def turns(self, turns: list[tuple[str, str]]) -> Iterator[tuple[list[int], int, int, int]]:
        """(ids, where the text begins, where it ends, characters as formatted) of each turn, without the begin of the conversation."""
        texts = self.encode([t for _, t in turns])
        written = sorted({r for r, _ in turns if r not in self.marks})
        roles = dict(zip(written, self.encode(written), strict=True)) if written else {}
        for (role, text), ids in zip(turns, texts, strict=True):
            mark = self.opening(role)
            before = [self.ids[mark[0]]] if len(mark) == 1 else [self.ids[WRITTEN_ROLE], *roles[role], self.ids[TEXT]]
            size = sum(len(x) for x in mark[::2]) + len(self.closing(role)) + len(self.escapes.escape(text))
            if len(mark) > 1:
                size += len(self.escapes.escape(role))
            yield [*before, *ids, self.ids[self.closing(role)]], len(before), len(before) + len(ids), size


_KEPT: dict[int, Template] = {}


def _template(made_of: tuple) -> Template:
    """One for each worker process, from (spec, pairs of roles and marks, learned roles)."""
    key = hash(made_of)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Template(made_of[0], dict(made_of[1]), made_of[2])
    return _KEPT[key]


def _shipped(spark: SparkSession, vocabulary: str, role_marks: dict[str, str] | None, learned: tuple[str, ...]):
    ship(spark)
    with open(vocabulary, encoding="utf-8") as f:
        return spark.sparkContext.broadcast((f.read(), tuple((ROLE_MARKS if role_marks is None else role_marks).items()), tuple(learned)))


_SEGMENTS = "conv_id long, seq long, start long, ids array<int>, mask array<tinyint>, n_chars long"


def format_chats(turns: DataFrame, vocabulary: str, role_marks: dict[str, str] | None = None, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) to a row for each turn, in order: (conv_id, seq, start, ids, mask, n_chars).

    ``start`` is the segment's place in its conversation's ids; the first segment has the begin mark before it. Partitions hold whole conversations, sorted."""
    spark = turns.sparkSession
    spec = _shipped(spark, vocabulary, role_marks, learned)

    def encode(batches):
        t = _template(spec.value)
        for b in batches:
            role, text = b.column("role").to_pylist(), b.column("text").to_pylist()
            out, at = [], 0
            while at < len(role):  # runs of bounded length, one text at least
                end, n = at, 0
                while end < len(role) and (end == at or n + len(text[end]) <= RUN):
                    n += len(text[end])
                    end += 1
                out += t.turns(list(zip(role[at:end], text[at:end], strict=True)))
                at = end
            ids, begins, ends, chars = zip(*out, strict=True) if out else ((), (), (), ())
            learn = [r in t.learned for r in role]
            cols = [b.column("conv_id"), b.column("turn"), b.column("role"), b.column("tie"), pa.array([np.array(x, t.packed).tobytes() for x in ids], pa.binary()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), pa.array(learn, pa.bool_()), pa.array(chars, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "turn", "role", "tie", "ids", "begins", "ends", "learn", "n_chars"])

    def assemble(batches):
        t = _template(spec.value)
        begin, begin_chars = t.ids[BEGIN], len(BEGIN)
        conv, seq, start = object(), 0, 0
        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in ("conv_id", "begins", "ends", "learn", "n_chars")}
            seqs, starts, ids, masks, chars = [], [], [], [], []
            for c, seg, s, e, learn, n in zip(cols["conv_id"], b.column("ids"), cols["begins"], cols["ends"], cols["learn"], cols["n_chars"], strict=True):
                seg = np.frombuffer(seg.as_buffer(), t.packed)
                if c != conv:
                    conv, seq, start = c, 0, 0
                    seg, s, e, n = np.concatenate([[begin], seg]), s + 1, e + 1, n + begin_chars
                steps = np.zeros(len(seg) + 1, np.int8)
                if learn:
                    steps[s] += 1
                    steps[e] -= 1
                seqs.append(seq)
                starts.append(start)
                ids.append(seg.astype(np.int32))
                masks.append(np.cumsum(steps[:-1], dtype=np.int8))
                chars.append(n)
                seq, start = seq + 1, start + len(seg)
            lists = [pa.array(x, pa.list_(kind)) for x, kind in ((ids, pa.int32()), (masks, pa.int8()))]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(seqs, pa.int64()), pa.array(starts, pa.int64()), *lists, pa.array(chars, pa.int64())], names=["conv_id", "seq", "start", "ids", "mask", "n_chars"])

    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("tie", F.unhex(F.sha2("text", 256))).mapInArrow(encode, "conv_id long, turn long, role string, tie binary, ids binary, begins int, ends int, learn boolean, n_chars long")
    dealt = rows.repartition(parallelism(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie")
    return dealt.mapInArrow(assemble, _SEGMENTS)


_TURNS = "conv_id long, seq long, role string, text string, learned string, n_chars long"


def read_chats(segments: DataFrame, vocabulary: str, role_marks: dict[str, str] | None = None, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """The turns that ``format_chats``'s rows say, from their ids and masks alone: (conv_id, seq, role, text, learned, n_chars), in the rows' order.

    ``learned`` is the text under the mask; marks have none."""
    spec = _shipped(segments.sparkSession, vocabulary, role_marks, learned)

    def run(batches):
        t = _template(spec.value)
        begin, role_id, text_id = t.ids[BEGIN], t.ids[WRITTEN_ROLE], t.ids[TEXT]
        back = {t.ids[m]: r for r, m in t.marks.items()}
        for b in batches:
            roles, texts, under = [], [], []
            for ids, mask in zip(b.column("ids"), b.column("mask"), strict=True):
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy().astype(bool)
                at = int(ids[0] == begin)
                if ids[at] == role_id:
                    cut = at + int(np.flatnonzero(ids[at:] == text_id)[0])
                    roles.append(t.text(ids[at + 1 : cut].tolist()))
                    at = cut
                else:
                    roles.append(back[int(ids[at])])
                end = at + 1 + int(np.flatnonzero(ids[at + 1 :] >= t.first)[0])
                texts.append(t.text(ids[at + 1 : end].tolist()))
                under.append(t.text(ids[mask & (ids < t.first)].tolist()))
            cols = [b.column("conv_id"), b.column("seq"), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array(under, pa.string()), b.column("n_chars")]
            yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "seq", "role", "text", "learned", "n_chars"])

    return segments.mapInArrow(run, _TURNS)


def digests(turns: DataFrame) -> DataFrame:
    """A row for each conversation of ``read_chats``'s rows, which stand sorted in their partitions; digests run on from turn to turn."""

    def run(batches):
        conv, state = None, None
        out = []

        def close():
            if state is not None:
                n, all_, chars, under, size = state
                out.append((conv, n, all_.hexdigest(), chars, under.hexdigest(), size))

        for b in batches:
            for x in b.to_pylist():
                if state is None or x["conv_id"] != conv:
                    close()
                    conv, state = x["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{x['role']}\n{x['text']}\n".encode())
                state[2] += len(x["learned"])
                state[3].update(x["learned"].encode())
                state[4] += x["n_chars"]
            yield _digest_rows(out)
            out.clear()
        close()
        yield _digest_rows(out)

    return turns.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_rows(rows) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 6
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op13_chat_format(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Formats all ``conversations`` and one whose texts are control strings, and reads the result back."""
    import public_tokenizers

    path = str(public_tokenizers.path(vocabulary))
    hard = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(own)
    return digests(read_chats(format_chats(turns, path), path))


_ESCAPED = "regexp_replace({c}, '(<)(\\\\*(?:s>|/s>|\\|endoftext\\|>))|(\\[)(\\\\*(?:ROLE\\]|TEXT\\]|/INST\\]|SYS\\]|INST\\]|OUT\\]|TOOL\\]))', '\\1\\3\\\\\\2\\4', 'g')"
SQL = f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (SELECT *, sha256(text) AS tie, length({_ESCAPED.format(c="text")}) + CASE role WHEN 'system' THEN 5 WHEN 'user' THEN 6 WHEN 'assistant' THEN 5 WHEN 'tool' THEN 6 ELSE 12 + length({_ESCAPED.format(c="role")}) END + CASE role WHEN 'assistant' THEN 4 ELSE 7 END AS size FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, tie)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, tie) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(size) + 3 AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""
