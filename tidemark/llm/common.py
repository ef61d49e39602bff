"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of the contracts: U+0020 and U+0009 to U+000D.
ASCII_SPACE = " \t\n\x0b\f\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Stands for a missing doc_id, which orders such rows after all others.
NO_ID = (1 << 63) - 1
# A side of at most so many short rows (a few dozen bytes each) is broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 200_000
ARROW_ROWS = 1000
ARROW_BYTES = 4 << 20
# A key is hot when it holds this share of the rows, so there are at most 1 / share hot keys.
HOT_SHARE = 1 / 500


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_arrow(
    df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``df.mapInArrow`` with small batches, so that neither the JVM nor the workers hold much text at a time.

    This lowers the session's Arrow batch limits to at most ``ARROW_ROWS`` and ``ARROW_BYTES``.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))

    def released(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(released, schema)


def text_hash() -> Column:
    """Hash of column ``text``, null as empty; with doc_id the key of a row."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII takes the short way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def within(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, to be broadcast if it is counted to be small; ``df`` should be a written table of short rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_counted(
    left: DataFrame, right: DataFrame, keys: Sequence[str], n: str, total: int, how: str = "inner"
) -> DataFrame:
    """Join ``left`` to the unique keys of ``right``, where ``right.n`` counts the rows of ``left`` by key.

    Keys with at least ``total * HOT_SHARE`` rows number at most ``1 / HOT_SHARE``: these are
    broadcast, so their rows never move.  All other keys are too small to skew a shuffle.
    ``how`` is inner or left.  Column ``n`` does not appear in the result.
    """
    keys = list(keys)
    hot = right.filter(F.col(n) >= max(1000, int(total * HOT_SHARE))).drop(n)
    cold = right.filter(F.col(n) < max(1000, int(total * HOT_SHARE))).drop(n)
    by_hot = left.join(F.broadcast(hot), keys)
    by_cold = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return by_hot.unionByName(by_cold)
