"""Exact deduplication with a heavy-hitter split.

A digest that many rows share would send them all to one task.  Misra-Gries summaries, one per task and merged by adding, name every
digest that can hold more than ``SHARE`` of the rows; a second look at the table counts these candidates exactly and finds the row of
each that stays.  The verified winners are broadcast, so rows of frequent digests are decided where they lie.  All other digests are
rare by proof and take an ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, read
from tidemark.session import materialize

# White space of the contract; runs of it are one space.
SPACES = r"[ \t\n\x0B\f\r]+"
# Counters of a summary.  A digest's merged count is at most rows / (COUNTERS + 1) too low and never too high.
COUNTERS = 1000
# A digest with this share of the rows must be found; as 1 / SHARE < COUNTERS, at most CANDIDATES digests reach the limit below.
SHARE = 1 / 500
CANDIDATES = 1000


def normalised(text: Column) -> Column:
    """Text with every run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, row, digest`` of every row, written once: ``row`` tells rows apart that agree in everything."""
    return materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.unhex(F.sha2(normalised(F.col("text").cast("string")), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        )
    )


def _shrink(counts: dict[bytes, int], counters: int) -> dict[bytes, int]:
    """At most ``counters`` counters: all are lowered by the largest count that does not fit."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return {key: n - cut for key, n in counts.items() if n > cut}


def summaries(keys: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``digest, low``: merged Misra-Gries summaries of the column ``digest``; rows lost by lowering are bounded, see ``COUNTERS``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            for found in batch.column(0).value_counts():
                key = found["values"].as_py()
                counts[key] = counts.get(key, 0) + found["counts"].as_py()
            counts = _shrink(counts, counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "low"])

    return map_arrow(keys.select("digest"), run, "digest binary, low long").groupBy("digest").agg(F.sum("low").alias("low"))


def winners(keys: DataFrame, total: int, counters: int = COUNTERS, share: float = SHARE) -> DataFrame:
    """``digest, first, n`` of all digests with at least ``total * share`` rows (and perhaps some rarer ones), counted exactly.

    A digest with that many rows has a merged count above ``total * (share - 1 / (counters + 1))``.  Merged counts add up
    to at most ``total``, so fewer than ``1 / (share - 1 / (counters + 1))`` digests do: the result is small whatever the table.
    """
    limit = total * (share - 1 / (counters + 1))
    candidates = materialize(summaries(keys, counters).filter(F.col("low") > limit).select("digest"))
    return materialize(_groups(keys.join(F.broadcast(candidates), "digest", "left_semi")))


def _groups(keys: DataFrame) -> DataFrame:
    """``digest, first, n``: the row that stays has the smallest doc_id, missing ones last; counts combine before the shuffle."""
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")
    return keys.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n"))


def dedup(docs: DataFrame, counters: int = COUNTERS, share: float = SHARE) -> DataFrame:
    """``doc_id, digest, keep_id, group_size, kept``: a row for each row of ``docs``, of which only ``doc_id`` and ``text`` are read.

    Of equal texts the row with the smallest doc_id stays.  Rows without doc_id come last, so ``keep_id`` is null only where no row of the
    group has one.  Of rows that agree in doc_id and text exactly one stays.  Null texts equal empty ones; an empty table gives no rows.
    """
    if share - 1 / (counters + 1) < 1 / (CANDIDATES + 1):
        raise ValueError(f"counters and share admit more than {CANDIDATES} frequent digests")
    keys = digests(docs)
    frequent = winners(keys, keys.count(), counters, share)
    rare = keys.join(F.broadcast(frequent.select("digest")), "digest", "left_anti")
    decided = keys.join(F.broadcast(frequent), "digest").unionByName(rare.join(_groups(rare), "digest"))
    return decided.select(
        "doc_id",
        "digest",
        F.col("first.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"),
    )


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision for every document; see :func:`dedup` for nulls, ties and repeated rows."""
    return dedup(read(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM texts
"""
