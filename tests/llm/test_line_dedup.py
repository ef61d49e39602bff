"""Line deduplication against brute force, over several batches and compactions."""

import random
import re

import pytest

from tidemark.llm.line_dedup import LineStore, dedup_lines


def key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({i: i + 32 for i in range(65, 91)})


def brute(rows):
    owner = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            k = key(line)
            owner[k] = min(owner.get(k, doc), doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def rows():
    rng = random.Random(3)
    pool = [f"Line number {i} of the pool" for i in range(40)] + ["short", "", "  ", "Été à la plage", "ÉTÉ à la plage\t"]
    spaced = lambda x: rng.choice(["", " ", "\t\x0b"]) + rng.choice([x, x.upper() if x.isascii() else x]) + rng.choice(["", "\r"])
    out = [(i, "\n".join(spaced(rng.choice(pool)) for _ in range(rng.randrange(0, 9)))) for i in range(60)]
    return out + [(60, None), (61, ""), (62, "\n"), (63, "the hot line of all"), (64, "x" * 20000 + "\n" + "x" * 20000)] + [
        (70 + i, "the hot line of all\nthe hot line of all") for i in range(50)
    ]


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_matches_brute_force(spark, batches):
    data = rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in data], "doc_id long, text string, n int, h1 string")
    assert sorted(map(tuple, dedup_lines(df, batches=batches).collect())) == brute(data)


def test_levels_are_compacted(spark):
    store = LineStore(spark, fan_in=2)
    for i in range(5):
        lines = spark.range(10 * i, 10 * i + 15).selectExpr(f"{i}L AS id", "0L AS row", "0 AS pos", "id AS h1", "id AS h2")
        assert store.add(lines).count() == (5 if i else 0)
    assert [len(level) for level in store.levels] == [1, 0, 1]
    assert sum(run.count() for run in store.runs()) == 55
    store.close()


def test_empty_and_rows_without_id(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_lines(empty).count() == 0
    df = spark.createDataFrame(
        [(None, "a long enough line"), (4, "a long enough line"), (4, "a long enough line"), (None, "another lonely line")],
        "doc_id long, text string",
    )
    got = sorted((str(r[0]), r[2], r[3]) for r in dedup_lines(df).collect())
    assert got == [
        ("4", 0, "a long enough line"), ("4", 0, "a long enough line"), ("None", 0, "another lonely line"), ("None", 1, ""),
    ]
