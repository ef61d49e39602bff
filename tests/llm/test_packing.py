"""Packing: exact ids, gapless sequences, number of sequences."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing

ODD = [
    "", " ", "\n\n  x", "it's they'll WE'RE 'd", "a_b __ c", "tab\t\ttab", "1234 56", "naïve Straße ñandú", "x²½ Ⅷ", "日本語 text", "a b c",
    "\x1cz\x1f", "<|endoftext|> y", "é combining", "😀😀 ok", "....!!! --", "\r\n\r\n", "…‘’“”€", "word " * 3000, "x" * 5000,
    "a<|endoftext|>b <|endoftext|>", "<|endoftext|", "日本<|endoftext|>", " " * 30_000 + "x", "日本" + "\n" * 30_000, " " * 9_999 + "x",
]


def reference_ids(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_ids_equal_those_of_the_tokenizer(text):
    assert np.frombuffer(packing.encoder()(text), "<u4").tolist() == reference_ids(text)


def test_very_long_runs_of_white_space(spark):
    rows = [(1, " " * 2_000_000 + "x"), (2, "\n" * 2_000_000), (3, "x" + " " * 700_000), (4, "\t \u3000" * 300_000 + "日"), (5, "ab" * 200_000)]
    found = packing.pieces(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id").sum("length").collect()
    assert dict(map(tuple, found)) == {i: len(reference_ids(text)) + 1 for i, text in rows}


def test_words_are_kept_within_bounds(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 3)
    words = packing.WordIds(lambda word: [len(word)])
    for word in ["a", "bb", "c" * 65, "dd", "e", "f"]:
        assert words[word] == np.array([len(word)], "<u4").tobytes()
    assert len(words) <= 3 and "c" * 65 not in words


def test_characters_of_the_short_way():
    text = " a".join(chr(i) for i in range(0x2100) if not 0xD800 <= i < 0xE000)
    words = [w for w in text.split("a") if not packing.OTHER.search(w)]
    assert len(words) > 500
    joined = "a".join(words)
    assert np.frombuffer(packing.encoder()(joined), "<u4").tolist() == reference_ids(joined)


def test_best_fit():
    bins = packing.best_fit(np.array([5, 7, 3, 5, 10, 2]), 10)
    assert sorted(map(sorted, bins)) == [[0, 3], [1, 2], [4], [5]]


def check(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("chunk", [50, 100_000])
def test_rounds_and_density(spark, monkeypatch, chunk):
    monkeypatch.setattr(packing, "CHUNK", chunk)
    rng = random.Random(4)
    rows = [(i, 0, 0, rng.randrange(1, 101), 0) for i in range(3000)]
    df = spark.createDataFrame(rows, packing.ITEM).repartition(20)
    out = packing.pack(df, capacity=100).collect()
    assert sorted(r.doc_id for r in out) == list(range(3000))
    bound = -(-sum(r[3] for r in rows) // 100)
    assert check(out, 100) <= bound * (1.05 if chunk > 50 else 1.08)


def test_items_that_never_fit_together(spark):
    df = spark.createDataFrame([(i, 0, 0, 60, 0) for i in range(500)], packing.ITEM).repartition(9)
    assert check(packing.pack(df, capacity=100).collect(), 100) == 500


def test_documents_whole(spark):
    rows = list(enumerate(ODD)) + [(None, None), (3, ODD[3]), (3, ODD[3])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, length int")
    out = packing.pack_documents(df, capacity=64).collect()
    check(out, 64)
    for doc, text in enumerate(ODD):
        ids = np.array(reference_ids(text) + [2], "<u4")
        own = sorted((r for r in out if r.doc_id == doc), key=lambda r: r.piece)
        if doc == 3:
            assert len(own) == 3
            continue
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 64 for r in own[1:])
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    assert packing.pack_documents(df.limit(0)).count() == 0
