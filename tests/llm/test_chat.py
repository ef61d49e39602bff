"""Chat formatting: folding, rendering and reading back."""

import hashlib
import random

from tidemark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, seq string, message int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, 10, "start", "user", None), (1, 1, 10, "delta", None, "helo"), (1, 5, 10, "edit", None, "hello"),
        (1, 2, 11, "start", "assistant", None), (1, 3, 11, "delta", None, "wro"), (1, 4, 11, "delta", None, "ng"),
        (1, 6, 11, "regenerate", None, None), (1, 8, 11, "delta", None, "ght"), (1, 7, 11, "delta", None, "ri"),
        (1, 9, 12, "delta", None, "no start"), (2, 0, 1, "start", "user", None), (None, 0, 1, "start", "user", "x"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string")
    got = sorted((str(r[0]), r[1], r[2], r[3]) for r in chat.fold_messages(df).collect())
    assert got == [
        ("1", 0, "user", "hello"), ("1", 2, "assistant", "right"), ("1", 9, "", "no start"), ("2", 0, "user", ""), ("None", 0, "user", "x"),
    ]


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>", "assistant", "\n", "\\", "\\s", "\\l", "\\n", "<", "|", "<|", "é😀", " ", "x" * 450]
    text = lambda: "".join(rng.choices(bits, k=rng.randrange(0, 9)))
    rows = [(c, t, rng.choice(["user", "assistant", "sys\ntem<|\\n", None]), rng.choice([text(), text(), None])) for c in range(25) for t in range(rng.randrange(1, 7))]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA)
    back = {r.conv_id: r for r in chat.parse(chat.format_chats(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        assert [(t.role, t.text) for t in back[conv].turns] == own
        assert list(back[conv].loss_texts) == [t for role, t in own if role == "assistant"]
        spans = [back[conv].formatted[s.start : s.end] for s in back[conv].loss]
        assert [s.replace("\\l", "<|").replace("\\s", "\\") for s in spans] == list(back[conv].loss_texts)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", "", 0)] * 3 + [(1, None, "user", "first", "", 0)], SCHEMA)
    (row,) = chat.parse(chat.format_chats(df)).collect()
    assert [t.text for t in row.turns] == ["first", "a", "a", "a"]
    assert chat.format_chats(df.limit(0)).count() == 0
