"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

The 64 bits are cut into six blocks.  Fingerprints that differ in at most three bits agree in at least three
blocks, so they share one of the 20 keys made of three blocks; 32 fixed bits keep accidental
neighbours rare at any corpus size.  Equal fingerprints are one node.  A key with two nodes is one pair; a key with
more nodes is solved as a group that returns only the edges of a spanning forest, never all pairs.
A group above ``GROUP`` nodes is split by a second pigeonhole over its free bits: those 31 to 33 bits become eight
sub-blocks of which five agree, and at most 2 ** 15 different fingerprints can share such a key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import NO_ID, join_counted, map_arrow, read, text_hash, within
from tidemark.llm.components import components
from tidemark.session import materialize

SHINGLE = 3
SEED = 42
MAX_BITS = 3
GROUP = 2000


def _blocks(bits: list[int], n: int) -> list[int]:
    """Masks of ``n`` nearly equal runs of the given bit positions."""
    cut = [round(i * len(bits) / n) for i in range(n + 1)]
    return [sum(1 << b for b in bits[cut[i] : cut[i + 1]]) for i in range(n)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


BLOCKS = _blocks(list(range(64)), 6)
MASKS = [sum(c) for c in combinations(BLOCKS, 3)]
SUB_MASKS = [
    [m | sum(c) for c in combinations(_blocks([b for b in range(64) if not m >> b & 1], 8), 5)] for m in MASKS
]


def fingerprint(text: bytes, size: int = SHINGLE, chunk: int = 65536) -> int:
    """Unsigned SimHash of one UTF-8 text; bit counts are kept over chunks of shingles, so long texts need little memory."""
    words = text.lower().split()  # bytes: lowers A-Z and splits at ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    first, last = starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, chunk):
        h = [digest(joined[a:b], SEED) for a, b in zip(first[at : at + chunk], last[at : at + chunk], strict=True)]
        bits = np.unpackbits(np.array(h, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprint_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        values = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("h"), pa.array(values.view(np.int64))], names=["doc_id", "h", "fp"]
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, h, fp`` (signed 64 bits; ``h`` of the text as in ``common.text_hash``) of every row; null and wordless texts have fingerprint zero."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash().alias("h"))
    return map_arrow(texts, _fingerprint_batches, "doc_id long, h long, fp long")


def spanning_edges(values: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints (breadth first, one row of distances at a time)."""
    values = np.sort(values)
    bits = values.view(np.uint64)
    left = np.arange(len(values))
    out, front = [], []
    while len(left):
        if not front:
            front, left = [left[0]], left[1:]
        at = front.pop()
        near = np.bitwise_count(bits[left] ^ bits[at]) <= max_bits
        found = left[near]
        out += [(int(values[at]), int(values[f])) for f in found]
        front += list(found)
        left = left[~near]
    return out


def _edge_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        edges = [e for group in batch.column("fps") for e in spanning_edges(np.array(group.values, dtype=np.int64))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"]
        )


def links(nodes: DataFrame, group: int = GROUP) -> DataFrame:
    """Edges ``a, b`` whose components are those of all links among the distinct ``fp`` of ``nodes``."""
    keyed = nodes.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(_signed(m)).alias("part")) for i, m in enumerate(MASKS)])
        ).alias("k"),
    ).select("fp", "k.block", "k.part")
    shared = materialize(
        keyed.groupBy("block", "part")
        .agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .filter("n > 1")
    )
    pairs = shared.filter("n = 2").select("a", "b").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    members = materialize(keyed.join(within(shared.filter("n > 2").select("block", "part", "n")), ["block", "part"]))
    small = members.filter(F.col("n") <= group).groupBy("block", "part").agg(F.collect_list("fp").alias("fps"))
    masks = F.array(*[F.array(*[F.lit(_signed(s)) for s in subs]) for subs in SUB_MASKS])
    large = (
        members.filter(F.col("n") > group)
        .select("fp", "block", F.posexplode(F.element_at(masks, F.col("block") + 1)).alias("sub", "mask"))
        .groupBy("block", "sub", F.col("fp").bitwiseAND(F.col("mask")).alias("part"))
        .agg(F.collect_list("fp").alias("fps"))
        .filter(F.size("fps") > 1)
    )
    grouped = map_arrow(small.select("fps").unionByName(large.select("fps")), _edge_batches, "a long, b long")
    return pairs.unionByName(grouped).distinct()


def simhash_components(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs(doc_id, text)``.

    Rows whose fingerprints differ in at most three bits are linked; ``component_id`` is the smallest doc_id
    reachable.  Wordless and null texts share fingerprint zero and are linked like any other.  Rows with equal
    doc_id are one document and share a component.  Rows without doc_id come after all others and are linked by their texts only; when
    no doc_id is reachable, they have a null component.  An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs).withColumn("id", F.coalesce("doc_id", F.lit(NO_ID))))
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    # A document that appears in several rows with different texts ties its fingerprints together.
    own = prints.filter(F.col("id") < NO_ID).select("id", "fp").distinct()
    several = own.groupBy("id").agg(F.min("fp").alias("v"), F.max("fp").alias("high")).filter("v < high").select("id", "v")
    ties = own.join(several, "id").selectExpr("fp AS u", "v")
    group_of = materialize(components(links(nodes.select("fp")).selectExpr("a AS u", "b AS v").unionByName(ties)))
    named = nodes.join(group_of.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "root").select("fp", "component_id", "n")
    return join_counted(prints.select("doc_id", "fp"), materialize(named), ["fp"], "n", prints.count()).select(
        "doc_id", "fp", F.when(F.col("component_id") < NO_ID, F.col("component_id")).alias("component_id")
    )


def kept_rows(docs: DataFrame) -> DataFrame:
    """``id, h``: of each group of rows with near texts the one with the smallest doc_id, then hash of the text; ``id`` is NO_ID without doc_id.

    Rows are linked by their texts only, so a doc_id or its lack never joins different texts.
    """
    prints = fingerprints(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "h", "fp")
    nodes = materialize(prints.groupBy("fp").agg(F.min(F.struct("id", "h")).alias("first")))
    group_of = materialize(components(links(nodes.select("fp")).selectExpr("a AS u", "b AS v"))).withColumnRenamed("node", "fp")
    named = nodes.join(group_of, "fp", "left").select(F.coalesce("component", "fp").alias("root"), "first")
    return named.groupBy("root").agg(F.min("first").alias("first")).select("first.id", "first.h")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
