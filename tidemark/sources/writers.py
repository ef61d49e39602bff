"""Sinks: report outputs, range-scoped replace, factor store appends and read-back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialize
from tidemark.sources import snapshots

FACTOR_KEY = ["source_run_id", "entity", "trade_date", "as_of_date", "factor_name"]
FACTOR_SCOPE = ["source_run_id", "as_of_date", "trade_date", "factor_name"]
# Columns by whose bounds the groups of a factor store are left unread.
FACTOR_BOUNDS = ["source_run_id", "trade_date", "as_of_date", "factor_name", "entity"]


def write_report(df: DataFrame, columns: Sequence[str], order: Sequence[str], path: str, form: str = "parquet", overwrite: bool = False) -> None:
    """Fixed column order and sort; an existing target fails unless ``overwrite``."""
    writer = df.select(*columns).orderBy(*order).write.mode("overwrite" if overwrite else "errorifexists")
    if form == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def replace_range(existing: DataFrame, incoming: DataFrame, scope: str) -> DataFrame:
    """Table after deleting every row in ``scope`` (SQL text) and adding the new rows.

    The result goes to a new path: overwriting only the partitions present in
    ``incoming`` would leave stale rows on dates that have none any more.
    """
    return existing.filter(f"NOT coalesce({scope}, false)").unionByName(incoming)


def clean_factor_rows(incoming: DataFrame) -> DataFrame:
    return incoming.filter("factor_value IS NOT NULL AND abs(factor_value) < double('Infinity')")


def append_conflicts(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """Keys that must not be appended: repeated in the input, or already stored."""
    clean = clean_factor_rows(incoming)
    repeated = clean.groupBy(*FACTOR_KEY).agg(F.expr("count(*) AS row_count")).filter("row_count > 1").selectExpr(
        *FACTOR_KEY, "'duplicate_in_input' AS conflict"
    )
    stored = clean.select(*FACTOR_KEY).distinct().join(store.select(*FACTOR_KEY), FACTOR_KEY, "left_semi").selectExpr(
        *FACTOR_KEY, "'already_stored' AS conflict"
    )
    return repeated.unionByName(stored)


def swap_in(df: DataFrame, path: str, bounds: Sequence[str] = ()) -> None:
    """Make ``df`` the newest version of the table at ``path``, which :func:`snapshots.read` shows; ``df`` may read the one before."""
    snapshots.replace(df, path, bounds)


def replace_range_at(spark: SparkSession, path: str, incoming: DataFrame, scope: str) -> None:
    """Replace the rows in ``scope`` (SQL text) of the table at ``path``; a missing table is created.

    Groups without a row in scope are left as they are.  Another writer's commit in between is a :class:`snapshots.Conflict`.
    """
    base = snapshots.current(spark, path)
    touched = snapshots.holding_where(spark, base, scope, incoming.schema)
    after = replace_range(base.read(spark, incoming.schema, touched), incoming, scope)
    snapshots.replace(after, path, base=base, dropped=touched)


def append_factor_rows(store: DataFrame | None, incoming: DataFrame, path: str) -> None:
    """Append clean rows to the store at ``path``; conflicts stop the write.

    ``store`` holds the keys that are taken; without it these are the store's, of which only groups are read whose bounds and key filter
    admit one of the new keys.  The rows are added to the very version they were checked against, else the commit is a
    :class:`snapshots.Conflict`.  NaN, infinite and null values are not stored.  The input is evaluated once.
    """
    spark = incoming.sparkSession
    clean = materialize(clean_factor_rows(incoming))
    base = snapshots.current(spark, path)
    repeated = clean.groupBy(*FACTOR_KEY).count().filter("count > 1")
    taken = snapshots.stored_keys(spark, base, clean, FACTOR_KEY, clean.schema) if store is None else append_conflicts(store, clean)
    if repeated.limit(1).count() or taken.limit(1).count():
        raise ValueError("duplicate factor keys in input or store")
    snapshots.add(clean, base, FACTOR_BOUNDS, FACTOR_KEY)


def replace_factor_scope(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """Store after replacing every (run, as-of, date, factor) that ``incoming`` covers."""
    clean = clean_factor_rows(incoming)
    covered = clean.select(*FACTOR_SCOPE).distinct()
    return store.join(covered, FACTOR_SCOPE, "left_anti").select(*clean.columns).unionByName(clean)


def replace_factor_scope_at(incoming: DataFrame, path: str) -> None:
    """Replace the covered scopes in the store at ``path``; only groups that hold a row of them are rewritten."""
    spark = incoming.sparkSession
    clean = materialize(clean_factor_rows(incoming))
    base = snapshots.current(spark, path)
    touched = snapshots.holding(base, clean.select(*FACTOR_SCOPE).distinct(), FACTOR_SCOPE, clean.schema)
    after = replace_factor_scope(base.read(spark, clean.schema, touched), clean)
    snapshots.replace(after, path, FACTOR_BOUNDS, FACTOR_KEY, base, touched)


def readback(stored: dict[str, DataFrame], expected: dict[str, DataFrame]) -> DataFrame:
    """Expected against stored row counts per dataset."""
    out = None
    for name in expected:
        count = stored[name].agg(F.expr("count(*)")).scalar()
        row = expected[name].agg(F.expr(f"'{name}' AS dataset"), F.expr("count(*) AS expected_rows")).select(
            "*", count.alias("stored_rows")
        )
        out = row if out is None else out.unionByName(row)
    return out.selectExpr("*", "expected_rows = stored_rows AS matches")
