"""Digests of a table's file groups: what a table fingerprint needs, kept per group and merged.

A group never changes, so its digest is made once: rows, the least and greatest value of date columns, and the distinct names of source columns.  These
merge by sum, minimum, maximum and union, so a fingerprint after an append reads the new groups only, and dropped groups simply do not take part.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialize
from tidemark.sources import snapshots

# A row with an empty name counts rows; one with ``low`` and ``high`` bounds a date column, one with ``member`` names a value of a source column.
DIGEST = "group string, name string, low string, high string, member string, row_count long"


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Whole digest folders; one without its mark of success was left by a stopped job."""
    at, files = snapshots.file_system(spark, f"{path}/digests")
    found = [s.getPath().toString() for s in files.listStatus(at)] if files.exists(at) else []
    return sorted(f for f in found if files.exists(snapshots.file_system(spark, f"{f}/_SUCCESS")[0]))


def stored(spark: SparkSession, path: str) -> DataFrame:
    folders = _folders(spark, path)
    if not folders:
        return spark.createDataFrame([], DIGEST)
    # Two refreshes at the same time may both have read a group; their rows are equal.
    return spark.read.schema(DIGEST).parquet(*folders).distinct()


def digest(rows: DataFrame, dates: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Digest rows of ``rows``, which have a column ``group``; the rows are read once."""
    ends = [f(c).alias(f"{n}_{c}") for c in dates for n, f in (("low", F.min), ("high", F.max))]
    parts = materialize(rows.groupBy("group", *names).agg(F.count(F.lit(1)).alias("row_count"), *ends))
    whole = parts.groupBy("group").agg(
        F.sum("row_count").alias("row_count"), *[f(f"{n}_{c}").alias(f"{n}_{c}") for c in dates for n, f in (("low", F.min), ("high", F.max))]
    )
    none = "CAST(NULL AS STRING)"
    bounds = [f"struct('{c}' AS name, CAST(low_{c} AS STRING) AS low, CAST(high_{c} AS STRING) AS high, {none} AS member, 0L AS row_count)" for c in dates]
    count = f"struct('' AS name, {none} AS low, {none} AS high, {none} AS member, row_count)"
    out = whole.selectExpr("group", f"inline(array({', '.join([count, *bounds])}))")
    if names:
        each = ", ".join(f"struct('{c}' AS name, CAST(`{c}` AS STRING) AS member)" for c in names)
        members = parts.selectExpr("group", f"inline(array({each}))").filter("member IS NOT NULL").distinct()
        out = out.unionByName(members.selectExpr("group", "name", f"{none} AS low", f"{none} AS high", "member", "0L AS row_count"))
    return out


def refresh(spark: SparkSession, snapshot: snapshots.Snapshot, schema, dates: Sequence[str], names: Sequence[str]) -> list[str]:
    """Write the digests that groups of the snapshot lack; only these groups are read.  Returns their names."""
    done = {r[0] for r in stored(spark, snapshot.path).filter("name = ''").select("group").collect()}  # one name a group, as in the manifest
    new = [g for g in snapshot.groups if g.name not in done]
    if new:
        rows = snapshot.read(spark, schema, new).selectExpr(*[f"`{c}`" for c in (*dates, *names)], snapshots.GROUP_OF_ROW)
        digest(rows, dates, names).write.parquet(f"{snapshot.path}/digests/{uuid.uuid4().hex}")
    return [g.name for g in new]


def merged(spark: SparkSession, snapshot: snapshots.Snapshot) -> DataFrame:
    """Digest rows of the snapshot's groups."""
    live = spark.createDataFrame([(g.name,) for g in snapshot.groups], "group string")
    return stored(spark, snapshot.path).join(live, "group", "left_semi")
