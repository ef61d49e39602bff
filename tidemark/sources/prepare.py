"""Completion and reshaping of provider tables before they are stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as col
from tidemark.functions.calendar import fill_effective
from tidemark.functions.ranks import first_per_key


def assemble_valuation(indicators: DataFrame, start: str, end: str) -> DataFrame:
    """Wide valuations from long (entity, day, indicator, value, seq) rows.

    The last row per day wins.  pe and pb must both exist, total_mv may be
    missing: one aggregation replaces the two joins.
    """

    def last(name: str) -> str:
        return f"max_by(value, seq) FILTER (WHERE indicator = '{name}')"

    def has(name: str) -> str:
        return f"count_if(indicator = '{name}') > 0"

    return (
        indicators.filter(f"trade_date BETWEEN DATE'{start}' AND DATE'{end}'")
        .groupBy("entity", "trade_date")
        .agg(
            F.expr(f"{last('pe_ttm')} AS pe_ttm"),
            F.expr(f"{last('pb')} AS pb"),
            F.expr(f"{last('total_mv')} AS total_mv"),
            F.expr(f"{has('pe_ttm')} AND {has('pb')} AS _both"),
        )
        .filter("_both")
        .drop("_both")
    )


def fix_bar_units(bars: DataFrame) -> DataFrame:
    """Vendor bars count lots: volume = lots x 100 and amount = volume x close."""
    return bars.selectExpr("entity", "trade_date", "close", "lots * 100 AS volume", "lots * 100 * close AS amount")


def fill_trade_date(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """First filled of several text date columns."""
    first = ", ".join(col.blank_to_null(n) for n in names)
    return df.withColumn("trade_date", F.expr(f"try_cast(coalesce({first}) AS DATE)"))


def cap_universe(codes: DataFrame, requested: DataFrame, max_symbols: int) -> DataFrame:
    """At most N codes in code order, requested ones first in line."""
    wanted = requested.select("code").distinct().withColumn("_requested", F.lit(1))
    return (
        codes.select("code").distinct()
        .join(wanted, "code", "left")
        .orderBy(F.desc_nulls_last("_requested"), "code")
        .limit(max_symbols)
        .selectExpr("code", "_requested IS NOT NULL AS requested")
    )


def missing_requested(codes: DataFrame, requested: DataFrame) -> DataFrame:
    return requested.select("code").distinct().join(codes.select("code"), "code", "left_anti")


def complete_securities(codes: DataFrame, securities: DataFrame, member_names: DataFrame, as_of: str) -> DataFrame:
    """One row per code with fallback name, exchange and listing date."""
    names = first_per_key(member_names.select("code", "stock_name"), ["code"], ["stock_name"]).withColumnRenamed(
        "stock_name", "_member_name"
    )
    return (
        codes.select("code")
        .join(securities, "code", "left")
        .join(names, "code", "left")
        .selectExpr(
            "code",
            f"coalesce({col.blank_to_null('stock_name')}, _member_name) AS stock_name",
            f"coalesce({col.blank_to_null('exchange')}, {col.exchange('code')}) AS exchange",
            f"coalesce(list_date, DATE'{as_of}') AS list_date",
            "list_date IS NULL AS synthetic_list_date",
        )
    )


def complete_members(members: DataFrame, calendar: DataFrame, index_code: str, source_tag: str, as_of: str) -> DataFrame:
    """Defaults, effective dates and one universe kind for the whole snapshot."""
    base = members.selectExpr(
        f"coalesce(index_code, '{index_code}') AS index_code", "code", f"coalesce(in_date, DATE'{as_of}') AS in_date",
        "in_publish", "in_effective", "out_date", "out_publish", "out_effective",
    )
    filled = fill_effective(base, "in_effective", "in_publish", "in_date", calendar)
    filled = fill_effective(filled, "out_effective", "out_publish", "out_date", calendar)
    # Decided over all rows before the index filter; a scalar subquery for every member.
    kind = base.agg(
        F.expr(
            f"CASE WHEN count(*) = 0 THEN 'empty' WHEN min(in_date) = max(in_date) AND min(in_date) = DATE'{as_of}' "
            "THEN 'current_snapshot' ELSE 'historical_pit' END"
        )
    )
    return filled.filter(F.col("index_code") == index_code).select(
        *filled.columns, F.lit(source_tag).alias("source"), F.lit(source_tag).alias("source_tag"),
        kind.scalar().alias("universe_kind"),
    )


def legacy_defaults(df: DataFrame) -> DataFrame:
    """Values for rows written before sources were recorded."""
    return df.withColumns(
        {
            "source_tag": F.expr("coalesce(source_tag, source, 'legacy')"),
            "source": F.expr("coalesce(source, 'legacy')"),
            "universe_kind": F.expr("coalesce(universe_kind, 'unknown_legacy')"),
        }
    )


def available_sources(tables: Sequence[DataFrame]) -> DataFrame:
    """Distinct usable source names; blanks and 'legacy' do not count."""
    out = None
    for df in tables:
        part = df.select("source").distinct()
        out = part if out is None else out.unionByName(part)
    return out.filter(f"{col.blank_to_null('source')} IS NOT NULL AND trim(source) <> 'legacy'").distinct()


def resolve_source(tables: Sequence[DataFrame]) -> DataFrame:
    """The single source, or a failed query when there are several."""
    found = available_sources(tables).agg(F.expr("count(*) AS n"), F.expr("min(source) AS source"))
    rule = "CASE WHEN n > 1 THEN raise_error('several data sources; choose one') ELSE source END"
    return found.selectExpr(f"CAST({rule} AS STRING) AS source")


def import_findings(incoming: DataFrame) -> DataFrame:
    """Overlapping intervals of an import, one row per finding."""
    from tidemark.operators.quality import interval_overlaps

    return interval_overlaps(incoming, ["source_tag", "index_code", "entity"])


def import_members(existing: DataFrame, incoming: DataFrame, overwrite: bool) -> DataFrame:
    """Members after an import that owns whole (source_tag, index) sets.

    Overlapping intervals stop the import (see :func:`import_findings`; rows without effective dates have none), and so does,
    without ``overwrite``, a set that already exists.
    """
    dated = {"in_effective", "out_effective"} <= set(incoming.columns)
    found = import_findings(incoming).limit(3).collect() if dated else []
    if found:
        raise ValueError(f"overlapping member intervals, among them {[(r.entity, r.issue) for r in found]}")
    sets = incoming.select("source_tag", "index_code").distinct()
    if overwrite:
        return existing.join(sets, ["source_tag", "index_code"], "left_anti").select(*incoming.columns).unionByName(incoming)
    present = existing.select("source_tag", "index_code").distinct().selectExpr("*", "true AS _present")
    guarded = incoming.join(present, ["source_tag", "index_code"], "left").selectExpr(
        *incoming.columns, "CASE WHEN _present THEN CAST(raise_error('members already present') AS BOOLEAN) ELSE true END AS _ok"
    )
    return existing.select(*incoming.columns).unionByName(guarded.filter("_ok").drop("_ok"))
