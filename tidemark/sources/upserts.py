"""Upserts into bucketed tables: only buckets that a changed key falls in are rewritten, and a batch is applied once.

The table is one of :mod:`snapshots` with one group per bucket of the key's hash.  An upsert reads the buckets of its keys, writes those that change as new
groups and publishes them together with the number of the batch, in one rename.  So a batch is in the table wholly or not at all, a
replayed one changes nothing, and a second writer gets :class:`snapshots.Conflict` and may try again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranks import first_per_key
from tidemark.session import materialize
from tidemark.sources import snapshots

# Buckets of a table made without a number; a rewrite costs a bucket, so large tables want buckets of about a file's size.
BUCKETS = 64


class KeyConflict(ValueError):
    """A key exists with another hash."""


def _same(keys: Sequence[str]) -> Column:
    rule = F.lit(True)
    for k in keys:
        rule &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return rule


def _renamed(df: DataFrame, keys: Sequence[str], *others: Column) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *others)


def upsert_at(
    incoming: DataFrame,
    path: str,
    keys: Sequence[str],
    hash_column: str,
    overwrite: bool = False,
    stream: str = "",
    batch: int | None = None,
    buckets: int = BUCKETS,
) -> dict[str, int] | None:
    """Insert new keys of ``incoming``; known keys are skipped or, with ``overwrite``, replaced.  Returns the rows per status.

    Null keys are equal to each other.  Without ``overwrite`` a known key with another ``hash_column`` is a :class:`KeyConflict`, and so are two
    incoming rows of one key with different hashes; incoming rows of one key and hash count once, the least by all columns.  Nothing is written then.
    ``batch``: a batch of ``stream`` that is not above the last one is not applied again, and the result is None; the numbers of a stream must
    rise, as those that ``foreachBatch`` passes do.  ``buckets`` counts for the first write only.
    """
    spark, columns = incoming.sparkSession, incoming.columns
    base = snapshots.current(spark, path)
    if batch is not None and base.batches.get(stream, -1) >= batch:
        return None
    buckets = base.buckets or buckets
    at = snapshots.bucket_of(keys, buckets).alias("_bucket")
    others = [c for c in columns if c not in (*keys, hash_column)]
    one = first_per_key(incoming, [*keys, hash_column], others) if others else incoming.distinct()
    rows = materialize(one.select(*columns, at))
    if rows.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise KeyConflict("rows of one key with different hashes")
    asked = {r[0] for r in rows.select("_bucket").distinct().collect()}  # at most one number a bucket
    held = base.read(spark, incoming.schema, [g for g in base.groups if g.bucket in asked])
    old = _renamed(held, keys, F.col(hash_column).alias("_old"), F.lit(True).alias("_known"))
    known = F.lit("overwritten") if overwrite else F.when(F.col("_old").eqNullSafe(F.col(hash_column)), "skipped").otherwise("conflict")
    status = materialize(
        rows.join(old, _same(keys), "left").select(*columns, "_bucket", F.when(F.col("_known").isNull(), "inserted").otherwise(known).alias("_status"))
    )
    counts = {s: n for s, n in status.groupBy("_status").count().collect()}
    if "conflict" in counts:
        raise KeyConflict(f"{counts['conflict']} keys exist with another hash")
    changed = status.filter("_status <> 'skipped'")
    touched = {r[0] for r in changed.select("_bucket").distinct().collect()}
    done = {} if batch is None else {stream: batch}
    written: list[snapshots.Group] = []
    if touched:
        before = base.read(spark, incoming.schema, [g for g in base.groups if g.bucket in touched])
        kept = before.join(_renamed(changed, keys), _same(keys), "left_anti")
        written = snapshots.write_buckets(kept.unionByName(changed.select(*columns)), path, keys, buckets)
    if touched or done:
        snapshots.publish(spark, base, [*[g for g in base.groups if g.bucket not in touched], *written], done, buckets)
    return counts
