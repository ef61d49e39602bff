"""Exact deduplication: hot digests, ties, nulls, and the guarantee of the summaries."""

import hashlib
import random
import re
from collections import Counter

import pytest

from tests.compare import compare, connect
from tidemark.llm import exact_dedup

SCHEMA = "doc_id long, text string, digest string, n int, row string"


def brute(rows):
    key = [hashlib.sha256(re.sub(r"[ \t\n\x0b\f\r]+", " ", t or "").encode()).hexdigest() for _, t in rows]
    ids = {k: min((i for (i, _), x in zip(rows, key) if x == k and i is not None), default=None) for k in key}
    return sorted(((str(i), str(ids[k]), key.count(k), k) for (i, _), k in zip(rows, key)))


def check(spark, rows, parts=5, **options):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(parts)
    got = exact_dedup.dedup(df, **options).collect()
    assert sorted((str(r[0]), str(r[2]), r[3], r[1].hex()) for r in got) == brute(rows)
    kept = Counter(r[1] for r in got if r[4])
    assert set(kept.values()) <= {1} and len(kept) == len({r[1] for r in got})
    assert all(r[0] == r[2] for r in got if r[4])
    return got


def test_hot_group_and_rare_ones(spark):
    rng = random.Random(3)
    rows = [(i, "hot  text" if i % 3 == 0 else f"text {rng.randrange(400)}") for i in rng.sample(range(10**6), 1500)]
    check(spark, rows)
    # Few counters, so that most digests are lowered away and only the hot one is split off.
    check(spark, rows, counters=20, share=0.2)


def test_nulls_blanks_ties_and_long_texts(spark):
    long = "word \t\n" * 200_000
    rows = [
        (5, None), (4, ""), (None, ""), (9, " "), (8, "\n\t \x0b\f\r"), (7, " "), (1, "a b"), (1, "a b"), (1, "a  b"), (2, "a\nb"),
        (None, "alone"), (None, "alone"), (3, long), (6, long.replace("\t\n", "")), (11, "A b"),
    ]
    got = check(spark, rows)
    assert {r[0] for r in got if r[4]} == {4, 8, 7, 1, None, 3, 11}
    assert exact_dedup.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_frequent_digest_is_found(spark):
    rng = random.Random(8)
    keys = [f"k{min(int(rng.paretovariate(0.6)), 3000)}" for _ in range(6000)]
    df = spark.createDataFrame([(k.encode(), i, i) for i, k in enumerate(keys)], "digest binary, doc_id long, row long").repartition(7)
    low = {bytes(r[0]).decode(): r[1] for r in exact_dedup.summaries(df, 40).collect()}
    real = Counter(keys)
    assert all(real[k] - len(keys) / 41 <= low.get(k, 0) <= real[k] for k in real)
    found = {bytes(r[0]).decode(): r[2] for r in exact_dedup.winners(df, len(keys), 40, 0.05).collect()}
    assert {k for k, n in real.items() if n >= 0.05 * len(keys)} <= set(found) and len(found) <= 39
    assert all(real[k] == n for k, n in found.items())


def test_the_broadcast_is_bounded(spark):
    with pytest.raises(ValueError):
        exact_dedup.dedup(spark.createDataFrame([], SCHEMA), counters=400)


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    status, note = compare(spark, connect(folder), "op12", exact_dedup.op12_exact_dedup, exact_dedup.ORACLE, folder)
    assert status == "ok", note
