"""Merkle manifest: blocks, batches and witnesses against trees built at once."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from tests.compare import compare, connect
from tidemark.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, key string, pos string, block int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    """Root and, per leaf, (sibling, on the left) by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for way, i in zip(ways, at):
            other = i ^ 1
            way.append((nodes[other] if other < len(nodes) else None, other < i))
        nodes, at = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], [i // 2 for i in at]
    return nodes[0], ways


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    below = {x: tree([leaf(r) for r in trees[x]]) for x in langs}
    root, above = tree([below[x][0] for x in langs])
    out = []
    for x, up in zip(langs, above):
        for r, way in zip(trees[x], below[x][1]):
            shown = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                shown = (*r[:4], r[4] + 1)
            at = leaf(shown)
            for other, on_left in way + up:
                at = h(at) if other is None else h(other, at) if on_left else h(at, other)
            proof = h(*[o for o, _ in way + up if o])
            out.append((str(r[0]), leaf(r), below[x][0], root, proof, at))
    return sorted(out)


def found(spark, batches, height):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1)
    frames = [manifest.leaves_of(spark.createDataFrame([(*r, "x", "y", 1) for r in b], SCHEMA), tampered) for b in batches]
    rows = manifest.verify(manifest.proven(frames, height)).collect()
    return sorted((str(r[0]), *(r[c].hex() for c in ("digest", "subroot", "root", "proof", "folded"))) for r in rows)


def corpus(n, langs, seed=1):
    rng = random.Random(seed)
    ids = sorted(rng.sample(range(-50, 10**6), n))
    return [(i, rng.choice([None, "", "ü text", f"t{i}"]), rng.choice(langs), rng.choice([None, "s"]), rng.choice([None, 5, 9])) for i in ids]


def test_a_block_equals_the_whole_tree():
    for n in range(1, 70):
        leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        root, siblings, steps = manifest.append_block(leaves, (n - 1).bit_length())
        want, ways = tree([x.hex() for x in leaves])
        assert root.hex() == want
        for own, s, step, way in zip(leaves, siblings, steps, ways):
            assert s.hex() == "".join(o for o, _ in way if o) and manifest.fold(own, s, step) == root


def test_many_levels_of_blocks(spark):
    rows = corpus(150, ["en"] * 9 + ["de", None, "", "é"])
    rows += [(None, "a", "en", None, 3), (None, "b", "en", None, 3), (7, "same", "fr", "s", 1), (7, "same", "fr", "s", 1), (7, "other", "fr", "s", 1)]
    rows += [(10**7, "long " * 100_000, "en", "s", 5)]
    want = brute(rows)
    assert found(spark, [rows], 2) == want
    assert found(spark, [rows], 10) == want


def test_batches_equal_one_append(spark):
    rows = corpus(90, ["en", "en", "en", "de", "fr"], seed=4)
    rows[16:16] = []
    want = brute(rows)
    for cuts in ((5, 37), (16, 64)):
        assert found(spark, [rows[: cuts[0]], rows[cuts[0] : cuts[1]], rows[cuts[1] :]], 2) == want


def test_a_full_block_is_not_built_again(spark):
    leaves = lambda ids: manifest.leaves_of(spark.createDataFrame([(i, f"t{i}", "en", "s", 1, "x", "y", 1) for i in ids], SCHEMA))
    trees = manifest.Manifest("doc_id long, shown binary", 2)
    sizes = []
    blocks = trees._blocks
    trees._blocks = lambda nodes, *rest: (sizes.append(nodes.count()), blocks(nodes, *rest))[1]
    trees.append(leaves(range(16)), ["doc_id", "digest"])
    assert sizes == [16, 4]
    sizes.clear()
    trees.append(leaves(range(16, 18)), ["doc_id", "digest"])
    # Two leaves, the root of their block, and the roots of both full blocks of the level above.
    assert sizes == [2, 1, 2]


def test_one_row_and_no_row(spark):
    assert found(spark, [corpus(1, ["en"])], 10) == brute(corpus(1, ["en"]))
    assert manifest.verify(manifest.proven([manifest.leaves_of(spark.createDataFrame([], SCHEMA))])).count() == 0


def test_tampering_shows(spark):
    rows = corpus(60, ["en", "de"])
    got = found(spark, [rows], 3)
    changed = {str(r[0]) for r in rows if zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None}
    assert {r[0] for r in got if r[3] != r[5]} == changed and changed


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    status, note = compare(spark, connect(folder), "op13", manifest.op13_manifest, manifest.ORACLE, folder)
    assert status == "ok", note
