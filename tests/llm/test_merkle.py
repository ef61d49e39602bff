"""Merkle fingerprints and neighbours."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tidemark.llm import merkle


def test_next_text_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET_BYTES", 200)
    rng = random.Random(1)
    ids = rng.sample(range(-1000, 100000), 300)
    rows = [(i, f"text of {i}") for i in ids] + [(ids[0], "twice"), (None, "no id"), (7 * 10**6, None)]
    got = {(r[0], r[1]): r[2] for r in merkle.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(((r[0] if r[0] is not None else -(1 << 63), r[1] or "") for r in rows), key=lambda r: (-r[0], r[1]))
    want = {}
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        want[(None if i == -(1 << 63) else i, t)] = nxt
    assert got == want


def test_one_row_and_no_row(spark):
    df = spark.createDataFrame([(1, "ab", "x")], "doc_id long, text string, bucket string")
    assert [tuple(r) for r in merkle.with_next(df).collect()] == [(1, "ab", "ab")]
    assert merkle.with_next(df.limit(0)).count() == 0


def test_roots_and_likeness(spark):
    long = "\n".join(f"Line {i} has some words of its own. And more of them {i * 7}." for i in range(2000))
    pairs = [
        ("same text", "same text"), ("a\nb", "a\nb\n"), ("a\n\nb", "a\nb"), ("a ", "a"), ("", ""), ("", "x"),
        (long, long.replace("Line 77 has", "Line 77 had")), ("one two three four five six", "seven eight nine ten"),
    ]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, x string, y string")
    for text, name in (("x", "a"), ("y", "b")):
        df = merkle.fingerprint(df, text, name)
    edits = F.size(merkle.differing("a", "b")).alias("edits")
    first = merkle.first_difference("a", "b").alias("first")
    rows = df.select("i", (F.col("a_root") == F.col("b_root")).alias("same"), merkle.likeness("a", "b").alias("near"), edits, first).orderBy("i").collect()
    assert [r.same for r in rows] == [True, False, False, False, True, False, False, False]
    assert rows[0].near == rows[4].near == 1.0 and rows[5].near == rows[7].near == 0.0
    assert 0.99 < rows[6].near < 1 and (rows[6].edits, rows[6].first) == (1, 77) and (rows[0].edits, rows[0].first) == (0, None)


def test_an_inserted_line_is_one_edit(spark):
    lines = [f"Paragraph {i} says this." for i in range(8)]
    old, new = "\n".join(lines[:4]) + "\n\n" + "\n".join(lines[4:]), "\n".join([lines[0], "A new line.", *lines[1:4]]) + "\n\n" + "\n".join(lines[4:])
    df = merkle.fingerprint(merkle.fingerprint(spark.createDataFrame([(old, new)], "x string, y string"), "x", "a"), "y", "b")
    size = lambda a, b, level: F.size(merkle.differing(a, b, level))
    got = df.select(size("a", "b", "paragraphs"), size("b", "a", "paragraphs"), size("a", "b", "sections"), merkle.first_difference("b", "a")).first()
    assert tuple(got) == (0, 1, 1, 1)


def test_trees_equal_brute_force(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices(["a", "word ", "é ", ". ", "\n", "\n\n", "\t", "!?", " "], k=rng.randrange(60)))) for i in range(120)]
    got = {r.i: r for r in merkle.fingerprint(spark.createDataFrame(rows, "i int, text string"), "text", "x").collect()}
    for i, text in rows:
        tree = []
        for section in text.split("\n\n"):
            tree.append([])
            for paragraph in section.split("\n"):
                found = [t for t in re.findall(merkle.LEAF, paragraph) if t]
                assert "".join(found) == paragraph
                tree[-1].append(sha("".join(map(sha, found))))
        sections = [sha("".join(s)) for s in tree]
        assert (got[i].x_root, got[i].x_sections, got[i].x_paragraphs) == (sha("".join(sections)), sections, [p for s in tree for p in s])


def test_query_with_nulls_and_repeated_rows(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    rows = [(1, "same text", "x"), (1, "same text", "y"), (2, None, None), (None, "", "z"), (None, "q " * 100_000, "z")]
    spark.createDataFrame(rows, "doc_id long, text string, own_root string").write.parquet(path)
    got = merkle.op4_merkle(spark, str(tmp_path)).collect()
    assert len(got) == 5 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    assert sorted(r.fingerprint for r in got if r.n_chars == 0) == [got_empty := next(r.fingerprint for r in got if r.doc_id == 2)] * 2 and len(got_empty) == 64
