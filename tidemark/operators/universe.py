"""Universe snapshots, fingerprints and fallback resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranks import first_per_key
from tidemark.operators.asof import intervals_on_dates

UNKNOWN_KIND = "coalesce(nullif(trim(universe_kind), ''), 'unknown_legacy')"


def snapshot_rows(
    members: DataFrame,
    dates: DataFrame,
    run_id: str,
    index_code: str | None,
    data_source: str | None = None,
    universe_source: str = "universe_members",
) -> DataFrame:
    """One row per member and date of a run, defaults filled in."""
    base = members if index_code is None else members.filter(F.col("index_code") == index_code)
    active = intervals_on_dates(base, dates).select(
        "entity", "trade_date", "index_code", "in_date", "source", "source_tag", "universe_kind"
    )
    fallback = f"'{data_source}'" if data_source else "CAST(NULL AS STRING)"
    return first_per_key(active, ["entity", "trade_date", "index_code"], ["in_date"]).selectExpr(
        f"'{run_id}' AS source_run_id",
        "trade_date",
        "trade_date AS as_of_date",
        "index_code",
        "entity",
        f"'{universe_source}' AS universe_source",
        f"coalesce(source, {fallback}) AS source",
        f"coalesce(source_tag, {fallback}) AS source_tag",
        "coalesce(universe_kind, 'unknown') AS universe_kind",
    )


def write_snapshot(rows: DataFrame, path: str) -> None:
    """Store the rows of a run; a run that is stored already is replaced, others stay."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("source_run_id").parquet(path)


def load_snapshot(store: DataFrame, run_id: str, day: str | None = None, index_code: str | None = None) -> DataFrame:
    out = store.filter(F.col("source_run_id") == run_id)
    if day is not None:
        out = out.filter(f"trade_date = DATE'{day}'")
    if index_code is not None:
        out = out.filter(F.col("index_code") == index_code)
    return out


def drop_run(store: DataFrame, run_id: str) -> DataFrame:
    return store.filter(f"source_run_id IS NULL OR source_run_id <> '{run_id}'")


def set_fingerprint(df: DataFrame, groups: list[str], member: str, out: str = "fingerprint") -> DataFrame:
    """Order-free fingerprint of the distinct members of each group.

    The eight 32-bit words of every member's SHA-256 are summed and the sums are
    hashed.  Sums combine map-side, so a group of any size needs no sorted list.
    """
    words = [
        F.expr(f"sum(CAST(conv(substring(h, {8 * i + 1}, 8), 16, 10) AS BIGINT)) AS w{i}") for i in range(8)
    ]
    sums = (
        df.select(*groups, member)
        .distinct()
        .selectExpr(*groups, f"sha2(CAST({member} AS STRING), 256) AS h")
        .groupBy(*groups)
        .agg(F.expr("count(*) AS member_count"), *words)
    )
    sums = sums.filter("member_count > 0")
    text = ", ".join(["member_count", *[f"w{i}" for i in range(8)]])
    return sums.selectExpr(*groups, "member_count", f"sha2(concat_ws('|', {text}), 256) AS {out}")


def first_available(candidates: list[tuple[str, DataFrame]]) -> DataFrame:
    """Per date, the rows of the first non-empty source: ``trade_date, entity, universe_source``."""
    rows = priorities = None
    for i, (name, df) in enumerate(candidates):
        part = df.select("trade_date", "entity").distinct().selectExpr(
            "trade_date", "entity", f"{i} AS priority", f"'{name}' AS universe_source"
        )
        rows = part if rows is None else rows.unionByName(part)
        # A source's dates need no distinct entities: they combine map-side to one row per date and task.
        found = df.selectExpr("trade_date", f"{i} AS priority")
        priorities = found if priorities is None else priorities.unionByName(found)
    best = priorities.groupBy("trade_date").agg(F.expr("min(priority) AS priority"))
    return rows.join(best, ["trade_date", "priority"]).drop("priority")


def kind_counts(universe: DataFrame) -> DataFrame:
    return universe.groupBy(F.expr(f"{UNKNOWN_KIND} AS universe_kind")).agg(F.expr("count(*) AS row_count"))


def kind_guard(universe: DataFrame, required: str = "historical_pit", source_tag: str | None = None) -> DataFrame:
    """Kinds and source tags found, and whether formal use is allowed."""
    tag = "coalesce(nullif(trim(source_tag), ''), nullif(trim(source), ''), 'unknown')"
    found = universe.groupBy(
        F.expr("coalesce(universe_kind, 'unknown') AS universe_kind"), F.expr(f"{tag} AS resolved_tag")
    ).agg(F.expr("count(*) AS row_count"))
    tag_ok = f"resolved_tag = '{source_tag}'" if source_tag else "true"
    return found.selectExpr("*", f"universe_kind = '{required}' AND {tag_ok} AS allowed")
