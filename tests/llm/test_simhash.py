"""SimHash components against brute force."""

import random

import xxhash

from tidemark.llm import simhash
from tidemark.llm.components import components


def brute(rows):
    prints = {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
        prints[doc] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    label = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return {d: (prints[d], label[d]) for d in prints}


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(12)]
    rows = []
    for i in range(90):
        t = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    return rows + [(100, None), (101, ""), (102, " \t"), (103, "One"), (104, "one"), (105, "two words"), (106, "É é x y")]


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, n int")
    got = {r[0]: (r[1] & (1 << 64) - 1, r[2]) for r in simhash.simhash_components(df).collect()}
    assert got == brute(rows)


def test_components_match_brute_force(spark):
    check(spark, texts())


def test_long_text_in_chunks():
    text = " ".join(str(i * i % 977) for i in range(5000)).encode()
    assert simhash.fingerprint(text) == simhash.fingerprint(text, chunk=17)


def test_large_groups_take_the_second_pigeonhole(spark):
    # A dense cloud: all 12-bit patterns of even positions have neighbours within three bits.
    values = [sum(1 << (3 * i) for i in range(12) if v >> i & 1) for v in range(0, 4096, 5)] + [1 << 40, (1 << 62) - 1]
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    want = components(simhash.links(nodes).selectExpr("a AS u", "b AS v")).collect()
    got = components(simhash.links(nodes, group=3).selectExpr("a AS u", "b AS v")).collect()
    assert sorted(want) == sorted(got) and len(want) > 700


def test_masks_cover_every_close_pair():
    rng = random.Random(1)
    for _ in range(300):
        flip = sum(1 << b for b in rng.sample(range(64), 3))
        own = [i for i, m in enumerate(simhash.MASKS) if not flip & m]
        assert own and all(any(not flip & s for s in simhash.SUB_MASKS[i]) for i in own)


def test_empty_table_and_repeated_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(empty).count() == 0
    rows = [(3, "a b c d"), (3, "quite another text here"), (5, "quite another text here"), (None, "solo text is this"), (7, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r[0]), str(r[2])) for r in simhash.simhash_components(df).collect())
    assert got == [("3", "3"), ("3", "3"), ("5", "3"), ("7", "3"), ("None", "None")]


def test_component_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (100, 100)], "u long, v long")
    got = dict(components(edges).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_rows_without_id_are_not_tied(spark):
    a, b = ("alpha beta gamma delta epsilon", "some quite unlike text of other words")
    rows = [(1, a), (2, b), (None, a), (None, b), (None, "a third text that stands alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r[0]), str(r[2])) for r in simhash.simhash_components(df).collect())
    assert got == [("1", "1"), ("2", "2"), ("None", "1"), ("None", "2"), ("None", "None")]
