"""Data checks, issue tables, profiles and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.universe import set_fingerprint

from tidemark.params import HARD_FILTERS

ISSUE_COLUMNS = ["dataset", "severity", "code", "message", "row_count"]


def missing(column: str) -> str:
    return f"({column} IS NULL OR trim(CAST({column} AS STRING)) = '')"


def counted_issues(df: DataFrame, dataset: str, rules: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Issue rows for ``(severity, code, message, condition)`` rules, in one pass over the data."""
    if not rules:
        return df.sparkSession.createDataFrame([], "dataset STRING, severity STRING, code STRING, message STRING, row_count BIGINT")
    counts = df.agg(*[F.expr(f"count_if({rule}) AS c{i}") for i, (_, _, _, rule) in enumerate(rules)])
    rows = ", ".join(f"'{dataset}', '{s}', '{c}', '{m}', c{i}" for i, (s, c, m, _) in enumerate(rules))
    return counts.selectExpr(f"stack({len(rules)}, {rows}) AS ({', '.join(ISSUE_COLUMNS)})").filter("row_count > 0")


def missing_columns(df: DataFrame, dataset: str, required: Sequence[str]) -> DataFrame:
    """An issue row for every required column that the table lacks, with the table's row count."""
    absent = [c for c in required if c not in df.columns]
    return counted_issues(
        df, dataset, [("error", "missing_required_column", f"{dataset} is missing column {c}.", "true") for c in absent]
    )


def required_values(df: DataFrame, dataset: str, required: Sequence[str]) -> DataFrame:
    return counted_issues(
        df,
        dataset,
        [("error", "missing_required_values", f"{dataset}.{c} has missing required values.", missing(c)) for c in required],
    )


def duplicate_key_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of rows that share their key with another row."""
    return (
        df.groupBy(*keys)
        .agg(F.expr("count(*) AS n"))
        .agg(F.expr("coalesce(sum(n) FILTER (WHERE n > 1), 0) AS duplicate_key_rows"))
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str], samples: int | None = None) -> DataFrame:
    """All duplicated keys with their row counts, or the first ``samples`` in key order."""
    found = df.groupBy(*keys).agg(F.expr("count(*) AS row_count")).filter("row_count > 1")
    return found if samples is None else found.orderBy(*keys).limit(samples)


# Issue codes and messages of the price and valuation checks.
PRICE_ERRORS = [
    ("error", "high_below_low", "daily_prices.high is below low.", "high < low"),
    ("error", "close_outside_high_low", "daily_prices.close is outside [low, high].", "close < low OR close > high"),
    ("error", "negative_volume", "daily_prices.volume is negative.", "volume < 0"),
    ("error", "negative_amount", "daily_prices.amount is negative.", "amount < 0"),
]
PRICE_WARNINGS = [
    ("warning", "missing_adj_factor", "daily_prices.adj_factor has missing values.", missing("adj_factor")),
    ("warning", "missing_limit_up", "daily_prices.limit_up has missing values.", missing("limit_up")),
    ("warning", "missing_limit_down", "daily_prices.limit_down has missing values.", missing("limit_down")),
    (
        "warning", "is_suspended_unreliable", "daily_prices.is_suspended is missing or not reliably sourced.",
        missing("is_suspended"),
    ),
]
VALUATION_WARNINGS = [
    ("warning", "non_positive_pe_ttm", "valuation_daily.pe_ttm contains non-positive values.", "pe_ttm <= 0"),
    ("warning", "non_positive_pb", "valuation_daily.pb contains non-positive values.", "pb <= 0"),
]


def issue_table(parts: Sequence[DataFrame]) -> DataFrame:
    """All issues, or one placeholder row when there are none."""
    out = parts[0].select(*ISSUE_COLUMNS)
    for part in parts[1:]:
        out = out.unionByName(part.select(*ISSUE_COLUMNS))
    none = out.agg(F.expr("count(*) AS n")).filter("n = 0").selectExpr(
        "'all' AS dataset", "'info' AS severity", "'no_validation_issues' AS code",
        "'No validation issues were emitted.' AS message", "CAST(NULL AS BIGINT) AS row_count",
    )
    return out.unionByName(none)


# ---- interval checks ------------------------------------------------------


def interval_issues(members: DataFrame, required: Sequence[str]) -> DataFrame:
    """Row-level findings: missing field or an end that is not after its start."""
    absent = " OR ".join(f"{c} IS NULL" for c in required)
    finding = (
        f"CASE WHEN {absent} THEN 'missing_required' WHEN out_effective <= in_effective THEN 'out_effective_not_after_in' "
        "WHEN out_date <= in_date THEN 'out_date_not_after_in' END"
    )
    return members.selectExpr("*", f"{finding} AS issue").filter("issue IS NOT NULL")


# Stands for the end of an open interval.
_NEVER = "DATE'9999-12-31'"


def interval_overlaps(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Intervals that begin before an earlier one of their key has ended, with the start (``prev_in``) and end (``prev_out``) of the
    earlier one that reaches furthest: all overlaps are found, also those with an interval several places before.

    Rows with the same start collapse first: they already are duplicates, and
    afterwards a key has at most one row per day, however many copies it had.
    """
    starts = intervals.groupBy(*keys, "in_effective").agg(
        F.expr("count(*) AS copies"),
        F.expr(f"CASE WHEN count(out_effective) = count(*) THEN max(out_effective) ELSE {_NEVER} END AS _end"),
    )
    reached = f"max(struct(_end, in_effective)) OVER (PARTITION BY {', '.join(keys)} ORDER BY in_effective ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    issue = (
        f"CASE WHEN copies > 1 THEN 'duplicate_start' WHEN _far._end = {_NEVER} THEN 'open_ended_overlap' "
        "WHEN in_effective < _far._end THEN 'overlap' END"
    )
    return (
        starts.selectExpr("*", f"{reached} AS _far")
        .selectExpr(
            *keys, "in_effective", "copies", "_far.in_effective AS prev_in", f"nullif(_far._end, {_NEVER}) AS prev_out", f"{issue} AS issue"
        )
        .filter("issue IS NOT NULL")
    )


def pit_issues(members: DataFrame) -> DataFrame:
    """Point-in-time rules of historical rows: publications present and not after effect."""
    some = "(out_date IS NOT NULL OR out_publish IS NOT NULL OR out_effective IS NOT NULL)"
    every = "(out_date IS NOT NULL AND out_publish IS NOT NULL AND out_effective IS NOT NULL)"
    issue = (
        "CASE WHEN in_publish IS NULL THEN 'missing_in_publish' WHEN to_date(in_publish) > in_effective THEN 'in_publish_after_effective' "
        f"WHEN {some} AND NOT {every} THEN 'incomplete_exit' WHEN {every} AND to_date(out_publish) > out_effective "
        "THEN 'out_publish_after_effective' END"
    )
    return members.filter("universe_kind = 'historical_pit'").selectExpr("*", f"{issue} AS issue").filter("issue IS NOT NULL")


# ---- profiles -------------------------------------------------------------


def _size(df: DataFrame):
    """Row count as a scalar subquery."""
    return df.agg(F.expr("count(*)")).scalar()


def _names(df: DataFrame, column: str) -> list:
    """Number and order-free fingerprint of all distinct names in a column, as scalar subqueries."""
    name = f"{column}_values"
    if column not in df.columns:
        return [F.lit(0).cast("long").alias(f"{column}_count"), F.lit(None).cast("string").alias(name)]
    names = df.filter(f"{column} IS NOT NULL").select(column)
    return [
        names.select(column).distinct().agg(F.expr("count(*)")).scalar().alias(f"{column}_count"),
        set_fingerprint(names, [], column, name).select(name).scalar().alias(name),
    ]


def source_names(df: DataFrame, dataset: str) -> DataFrame:
    """``dataset, column_name, value, row_count``: every source and source tag of a table."""
    out = None
    for column in ("source", "source_tag"):
        if column in df.columns:
            rows = df.filter(f"{column} IS NOT NULL").groupBy(F.col(column).alias("value")).agg(F.expr("count(*) AS row_count"))
            rows = rows.selectExpr(f"'{dataset}' AS dataset", f"'{column}' AS column_name", "CAST(value AS STRING) AS value", "row_count")
            out = rows if out is None else out.unionByName(rows)
    return out


def dataset_summary(
    df: DataFrame, dataset: str, keys: Sequence[str], date_column: str, symbols: DataFrame | None = None, days: DataFrame | None = None
) -> DataFrame:
    """Rows, entities, date span, sources, duplicate rows and coverage of one table.

    Sources and tags are counted and fingerprinted; :func:`source_names` lists them all.
    """
    # One row per key: duplicates and counts come from the same aggregation.
    per_key = df.groupBy(*keys).agg(
        F.expr("count(*) AS n"), F.expr(f"min({date_column}) AS lo"), F.expr(f"max({date_column}) AS hi")
    )
    base = per_key.agg(
        F.expr(f"'{dataset}' AS dataset"),
        F.expr("coalesce(sum(n), 0) AS row_count"),
        F.expr("count(DISTINCT entity) AS stock_count") if "entity" in keys else F.expr("CAST(NULL AS BIGINT) AS stock_count"),
        F.expr("min(lo) AS start_date"),
        F.expr("max(hi) AS end_date"),
        F.expr("coalesce(sum(n) FILTER (WHERE n > 1), 0) AS duplicate_key_rows"),
    )
    out = base
    for column in ("source", "source_tag"):
        out = out.select("*", *_names(df, column))
    if symbols is None or days is None:
        return out.selectExpr("*", "CAST(NULL AS DOUBLE) AS coverage_rate")
    sizes = out.select("*", _size(symbols).alias("_s"), _size(days).alias("_d"))
    return sizes.selectExpr(*out.columns, "try_divide(row_count, _s * _d) AS coverage_rate")


def field_summary(df: DataFrame, dataset: str, fields: Sequence[str]) -> DataFrame:
    present = [f for f in fields if f in df.columns]
    counts = df.agg(F.expr("count(*) AS row_count"), *[F.expr(f"count_if({f} IS NULL) AS m_{f}") for f in present])
    rows = ", ".join(f"'{f}', {f'm_{f}' if f in present else 'row_count'}" for f in fields)
    return counts.selectExpr("row_count", f"stack({len(fields)}, {rows}) AS (field, missing_count)").selectExpr(
        f"'{dataset}' AS dataset", "field", "row_count", "missing_count",
        "coalesce(try_divide(missing_count, row_count), 0.0D) AS missing_rate",
    )


# ---- gate -----------------------------------------------------------------


def _percent(x: str) -> str:
    return f"format_string('%.2f%%', {x} * 100)"


def gate_row(df: DataFrame, check: str, ok: str, severity: str, observed: str, expected: str) -> DataFrame:
    return df.selectExpr(
        f"'{check}' AS check_name", f"CASE WHEN {ok} THEN 'PASS' ELSE 'FAIL' END AS status", f"{severity} AS severity",
        f"{observed} AS observed", f"{expected} AS expected",
    )


def calendar_gate(calendar: DataFrame, day: str) -> DataFrame:
    from tidemark.functions.calendar import is_open_on

    return gate_row(
        is_open_on(calendar, day), "trading_calendar_open", "calendar_rows > 0 AND is_open", "'blocking'",
        "concat('rows=', calendar_rows, '; is_open=', is_open)", "'row exists and is_open=true'",
    )


def universe_gate(universe: DataFrame) -> DataFrame:
    sizes = universe.select("entity").distinct().agg(F.expr("count(*) AS n"))
    return gate_row(sizes, "target_universe", "n > 0", "'blocking'", "CAST(n AS STRING)", "'> 0'")


def kind_gate(kind_counts: DataFrame) -> DataFrame:
    """PASS for a purely historical universe, WARN for a mixed one, FAIL for an empty one."""
    # One row per universe kind: a handful of rows.
    text = "array_join(transform(array_sort(collect_list(struct(universe_kind, row_count))), x -> concat(x.universe_kind, '=', x.row_count)), '; ')"
    agg = kind_counts.agg(
        F.expr(f"{text} AS kinds"), F.expr("count(*) AS n"), F.expr("count_if(universe_kind = 'historical_pit') AS h")
    )
    return agg.selectExpr(
        "'universe_kind_profile' AS check_name",
        "CASE WHEN n = 0 THEN 'FAIL' WHEN n = h THEN 'PASS' ELSE 'WARN' END AS status",
        "CASE WHEN n = 0 THEN 'blocking' WHEN n = h THEN 'info' ELSE 'warning' END AS severity",
        "CASE WHEN n = 0 THEN 'none' ELSE kinds END AS observed",
        "'historical_pit for formal research' AS expected",
    )


def coverage_gate(covered: DataFrame, universe: DataFrame, check: str, minimum: float) -> DataFrame:
    """Share of the universe that has a row in ``covered``."""
    hit = covered.select("entity").distinct().selectExpr("entity", "1 AS _hit")
    counts = universe.select("entity").distinct().join(hit, "entity", "left").agg(
        F.expr("count(*) AS n"), F.expr("count(_hit) AS c")
    )
    share = "coalesce(try_divide(c, n), 0.0D)"
    return gate_row(
        counts, check, f"n > 0 AND {share} >= {minimum}D", "'blocking'",
        f"CASE WHEN n = 0 THEN '0/0' ELSE concat(c, '/', n, ' (', {_percent(share)}, ')') END",
        f"'>= {minimum:.2%}'",
    )


def factor_gate(rows: DataFrame, universe: DataFrame, minimum: float) -> DataFrame:
    counts = rows.agg(
        F.expr("count(*) AS r"), F.expr("count(DISTINCT entity) AS s"), F.expr("count(DISTINCT factor_name) AS f")
    ).select("*", _size(universe.select("entity").distinct()).alias("n"))
    return gate_row(
        counts, "factor_values_source_run", f"r > 0 AND coalesce(try_divide(s, n), 0.0D) >= {minimum}D", "'blocking'",
        "concat('rows=', r, '; stocks=', s, '/', n, '; factors=', f)", f"'rows > 0 and stock coverage >= {minimum:.2%}'",
    )


def hard_filter_gate(rows: DataFrame, universe: DataFrame, minimum: float) -> DataFrame:
    """Entities that have every hard filter."""
    complete = (
        rows.filter(F.col("factor_name").isin(HARD_FILTERS))
        .groupBy("entity")
        .agg(F.expr("count(DISTINCT factor_name) AS k"))
        .filter(f"k >= {len(HARD_FILTERS)}")
    )
    return coverage_gate(complete, universe, "hard_filter_coverage", minimum)


def optional_gate(facts: DataFrame, table: str, day: str, allow_missing: bool = True) -> DataFrame:
    n = facts.agg(F.expr(f"count_if(effective_date <= DATE'{day}') AS n"))
    low, severity = ("WARN", "warning") if allow_missing else ("FAIL", "blocking")
    return n.selectExpr(
        f"'{table}_available' AS check_name", f"CASE WHEN n > 0 THEN 'PASS' ELSE '{low}' END AS status",
        f"CASE WHEN n > 0 THEN 'info' ELSE '{severity}' END AS severity", "CAST(n AS STRING) AS observed",
        "CASE WHEN n > 0 THEN '> 0' ELSE '> 0 or configured downgrade' END AS expected",
    )


def assemble_gate(checks: Sequence[DataFrame]) -> DataFrame:
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out


def gate_summary(gate: DataFrame) -> DataFrame:
    return gate.groupBy("status").agg(
        F.expr("count(*) AS check_count"), F.expr("bool_or(status = 'FAIL' AND severity = 'blocking') AS blocking")
    )
