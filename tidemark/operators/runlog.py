"""Picks, completeness checks and fingerprints over run and event logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ranks import first_per_key
from tidemark.operators.universe import set_fingerprint
from tidemark.sources import digests, snapshots

FINISHED = "coalesce(finished_at, started_at)"
# Columns a table fingerprint looks at.
DATE_COLUMNS = ["trade_date", "as_of_date", "effective_date", "publish_time", "created_at"]
SOURCE_COLUMNS = ["source", "source_tag"]


def succeeded(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Runs with artifacts that succeeded; a missing status counts as success."""
    with_files = runs.join(artifacts.select("run_id").distinct(), "run_id", "left_semi")
    return with_files.filter("coalesce(status, 'succeeded') = 'succeeded'")


def latest_per_kind(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    rows = succeeded(runs, artifacts).selectExpr("kind", f"{FINISHED} AS at", "run_id")
    return first_per_key(rows, ["kind"], ["at DESC", "run_id"])


def previous_per_kind(runs: DataFrame, artifacts: DataFrame, before: str, exclude: int | None = None) -> DataFrame:
    rows = succeeded(runs, artifacts).filter(f"as_of_date < DATE'{before}'")
    if exclude is not None:
        rows = rows.filter(f"run_id <> {exclude}")
    rows = rows.selectExpr("kind", "as_of_date", f"{FINISHED} AS at", "run_id")
    return first_per_key(rows, ["kind"], ["as_of_date DESC", "at DESC", "run_id DESC"])


def bundle(runs: DataFrame, artifacts: DataFrame, kind: str) -> DataFrame:
    """Artifact rows of a kind with the metadata of their run."""
    meta = runs.filter(F.col("kind") == kind).selectExpr("run_id", "kind", "status", "as_of_date")
    return artifacts.join(meta, "run_id")


def missing_files(runs: DataFrame, artifacts: DataFrame, required: Sequence[str]) -> DataFrame:
    """Required file names a run has no artifact for."""
    names = ", ".join(f"'{n}'" for n in required)
    expected = runs.selectExpr("run_id", f"explode(array({names})) AS file_name")
    present = artifacts.selectExpr("run_id", "element_at(split(path, '/'), -1) AS file_name")
    return expected.join(present, ["run_id", "file_name"], "left_anti")


def recent_runs(runs: DataFrame, limit: int, formal: bool = False) -> DataFrame:
    out = runs.filter("get_json_object(params, '$.run_mode') = 'formal'") if formal else runs
    return (
        out.selectExpr("run_id", "kind", "status", f"{FINISHED} AS at")
        .orderBy(F.desc_nulls_last("at"), "run_id")
        .limit(limit)
    )


def artifact_rows(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Every artifact with its run's kind and the directory it is grouped by: all members of the groups, as rows and not as lists."""
    rows = artifacts.selectExpr(
        "run_id", "regexp_replace(path, '/[^/]*$', '') AS directory", "element_at(split(path, '/'), -1) AS file_name", "path",
        "row_count", "created_at",
    )
    return rows.join(runs.select("run_id", "kind", "status"), "run_id", "left")


def artifact_groups(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One row per (run, kind, directory); members stay in the artifact table.

    Only mergeable aggregates: a directory with millions of files costs no more
    than one with a single file.
    """
    rows = artifacts.selectExpr(
        "run_id", "regexp_replace(path, '/[^/]*$', '') AS directory", "element_at(split(path, '/'), -1) AS file_name",
        "row_count", "created_at",
    )
    groups = rows.groupBy("run_id", "directory").agg(
        F.expr("count(*) AS artifact_count"),
        F.expr("sum(row_count) AS row_count"),
        F.expr("min(file_name) AS first_file"),
        F.expr("max(file_name) AS last_file"),
        F.expr("max(created_at) AS newest"),
    )
    meta = runs.selectExpr("run_id", "kind", "finished_at", "started_at")
    return groups.join(meta, "run_id", "left").selectExpr(
        "run_id", "kind", "directory", "artifact_count", "row_count", "first_file", "last_file",
        "coalesce(finished_at, newest, started_at) AS updated_at",
    )


def table_fingerprint(df: DataFrame, table: str) -> DataFrame:
    """Row count, date spans and source names of a table, and their hash."""
    dates = [c for c in DATE_COLUMNS if c in df.columns]
    sources = [c for c in SOURCE_COLUMNS if c in df.columns]
    aggs = ["count(*) AS row_count"]
    for c in dates:
        aggs += [f"CAST(min({c}) AS STRING) AS {c}_min", f"CAST(max({c}) AS STRING) AS {c}_max"]
    return _hashed(df.agg(*[F.expr(a) for a in aggs]), {c: df.select(c) for c in sources}, table)


def stored_fingerprint(spark: SparkSession, path: str, schema, table: str) -> DataFrame:
    """:func:`table_fingerprint` of the newest version of a table with versions, from its groups' digests.

    Only groups without a digest are read; after an append these are the new ones.
    """
    kinds = dict(spark.createDataFrame([], schema).dtypes)
    dates, sources = [c for c in DATE_COLUMNS if c in kinds], [c for c in SOURCE_COLUMNS if c in kinds]
    snapshot = snapshots.current(spark, path)
    digests.refresh(spark, snapshot, schema, dates, sources)
    rows = digests.merged(spark, snapshot)
    aggs = ["CAST(coalesce(sum(row_count), 0) AS BIGINT) AS row_count"]
    for c in dates:
        aggs += [f"CAST({f}(CAST({v} AS {kinds[c]})) FILTER (WHERE name = '{c}') AS STRING) AS {c}_{f}" for f, v in (("min", "low"), ("max", "high"))]
    return _hashed(rows.agg(*[F.expr(a) for a in aggs]), {c: rows.filter(F.col("name") == c).select(F.col("member").alias(c)) for c in sources}, table)


def _hashed(out: DataFrame, sources: dict[str, DataFrame], table: str) -> DataFrame:
    for c, values in sources.items():
        # All distinct names, as an order-free fingerprint of their set.
        names = set_fingerprint(values.filter(f"{c} IS NOT NULL"), [], c, "names").select("names")
        out = out.select("*", names.scalar().alias(f"{c}_values"))
    cells = [f"coalesce(CAST({c} AS STRING), '')" for c in out.columns]
    material = f"concat_ws('|', '{table}', {', '.join(cells)})"
    return out.selectExpr(f"'{table}' AS table_name", "row_count", f"{material} AS material").selectExpr(
        "table_name", "row_count", "material", "sha2(material, 256) AS fingerprint"
    )


def snapshot_id(fingerprints: Sequence[DataFrame]) -> DataFrame:
    """One id over the fingerprints of several tables (a fixed, short list)."""
    out = fingerprints[0]
    for df in fingerprints[1:]:
        out = out.unionByName(df)
    ordered = "array_join(transform(array_sort(collect_list(struct(table_name, fingerprint))), x -> concat(x.table_name, ':', x.fingerprint)), '|')"
    return out.agg(F.expr(f"sha2({ordered}, 256) AS snapshot_id"), F.expr("count(*) AS table_count"))
