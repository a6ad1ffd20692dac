"""Chat formatting: escapes and round trips against plain Python."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from laddersmith.llm import chat

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
CONTROLS = [chat.BEGIN, chat.WRITTEN_ROLE, chat.TEXT, chat.END_TURN, chat.END_LEARNED, *chat.ROLE_MARKS.values(), "<|endoftext|>"]
ESCAPES = chat.Escape(CONTROLS)
HARD = st.lists(st.sampled_from([*CONTROLS, "\\", "<", "[", "s>", "INST]", "/", "<\\s>", "[\\\\INST]", "é", " ", "\n", "x"]), max_size=14).map("".join)


@settings(deadline=None, max_examples=400)
@given(HARD)
def test_escapes_are_reversible_and_leave_no_mark(s):
    e = ESCAPES.escape(s)
    assert ESCAPES.unescape(e) == s
    assert not any(c in e for c in CONTROLS)


@settings(deadline=None, max_examples=200)
@given(HARD, HARD)
def test_marks_around_texts_stay_the_only_marks(a, b):
    whole = chat.ROLE_MARKS["user"] + ESCAPES.escape(a) + chat.END_TURN + chat.ROLE_MARKS["assistant"] + ESCAPES.escape(b) + chat.END_LEARNED
    assert sum(whole.count(c) for c in CONTROLS) == 4


def test_control_strings_that_cannot_be_escaped_are_refused():
    with pytest.raises(ValueError):
        chat.Escape(["<<SYS>>"])


def corpus():
    rng = random.Random(2)
    words = ["plain", "words", "</s>", "[INST]", "[\\INST]", "<\\\\s>", "<|endoftext|>", "naïve", "中文", "🙂", "\n", "  ", "\0"]
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, ("system", "user", "assistant", "tool")[rng.randrange(4)], " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))))
    rows += [(100, t, ("user", "assistant")[t % 2], f"turn {t} " * 3) for t in range(3000)]  # longer than a batch
    rows += [(101, None, None, None), (101, 0, "critic [ROLE]", "[TEXT] odd role"), (101, 0, "assistant", ""), (101, 0, "assistant", "tie b"), (101, 0, "assistant", "tie a"), (101, 0, "assistant", "tie a")]
    rows += [(None, 1, "assistant", "no id"), (None, 0, "user", "no id either"), (102, 0, "assistant", "long " * 60000)]
    rng.shuffle(rows)
    return rows


def brute(rows):
    groups, out = {}, {}
    for r in [*rows, (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]:
        groups.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    for c, turns in groups.items():
        turns.sort(key=lambda x: (*x[:3], hashlib.sha256(x[3].encode()).hexdigest()))
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        learned = "".join(t for *_, r, t in turns if r == "assistant")
        formatted = chat.BEGIN
        for *_, r, t in turns:
            opening = chat.ROLE_MARKS.get(r) or chat.WRITTEN_ROLE + ESCAPES.escape(r) + chat.TEXT
            formatted += opening + ESCAPES.escape(t) + (chat.END_LEARNED if r == "assistant" else chat.END_TURN)
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted))
    return out


def write(path, rows):
    cols = list(zip(*rows, strict=True)) if rows else [()] * 4
    extra = {c: pa.array(["x"] * len(rows), pa.string()) for c in ("ids", "mask", "tie", "seq", "start")}
    path.mkdir()
    pq.write_table(pa.table({"conv_id": pa.array(cols[0], pa.int64()), "turn": pa.array(cols[1], pa.int64()), "role": pa.array(cols[2], pa.string()), "text": pa.array(cols[3], pa.string()), **extra}), path / "conversations.parquet")
    return str(path)


def test_every_conversation_reads_back(spark, tmp_path):
    rows = corpus()
    got = {r[0]: tuple(r)[1:] for r in chat.op13_chat_format(spark, write(tmp_path / "c", rows)).collect()}
    assert got == brute(rows)


def test_empty_table_has_the_one_conversation(spark, tmp_path):
    got = [tuple(r) for r in chat.op13_chat_format(spark, write(tmp_path / "c", [])).collect()]
    assert got == [(-1, *brute([])[-1])]


def test_segments_join_to_the_ids_of_the_parts(spark):
    """Starts are running sums; ids are the library's for each part alone; the mask covers learned texts only."""
    rows = [(1, 0, "user", "a [INST] b"), (1, 1, "assistant", "yes </s> no"), (1, 2, "user", ""), (1, 3, "assistant", "end")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_chats(df, PATH).orderBy("seq").collect()
    model = Tokenizer.from_file(PATH)
    base = model.get_vocab_size(with_added_tokens=True)
    mark = {c: base + i for i, c in enumerate([chat.BEGIN, chat.WRITTEN_ROLE, chat.TEXT, chat.END_TURN, chat.END_LEARNED, *chat.ROLE_MARKS.values()])}
    ids, mask = [mark[chat.BEGIN]], [0]
    for _, _, role, text in rows:
        part = model.encode(ESCAPES.escape(text), add_special_tokens=False).ids
        ids += [mark[chat.ROLE_MARKS[role]], *part, mark[chat.END_LEARNED if role == "assistant" else chat.END_TURN]]
        mask += [0, *[int(role == "assistant")] * len(part), 0]
    assert [i for r in got for i in r.ids] == ids and [i for r in got for i in r.mask] == mask
    assert [r.start for r in got] == [sum(len(x.ids) for x in got[:i]) for i in range(4)]


def test_other_roles_and_learned_roles(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "critic", "c")], "conv_id long, turn long, role string, text string")
    kw = {"role_marks": {"critic": "[CRIT]"}, "learned": ("critic",)}
    got = chat.read_chats(chat.format_chats(df, PATH, **kw), PATH, **kw).orderBy("seq").collect()
    assert [(r.role, r.text, r.learned) for r in got] == [("user", "q", ""), ("critic", "c", "c")]
