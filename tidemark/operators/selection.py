"""Candidate scan and equal-weight targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranks import first_per_key
from tidemark.params import HARD_FILTERS, direction

# Texts of the candidate report.
NO_RISK_TEXT = "未触发本阶段规则风险提示"
MISSING_TEXT = "展示因子缺失："
TIPS = [
    ("pe_ttm_percentile >= 0.8D", "估值处于自身历史高位"),
    ("pb_percentile >= 0.8D", "PB 处于自身历史高位"),
    ("return_20d < 0", "20 日动量为负"),
    ("return_60d < 0", "60 日动量为负"),
    ("above_ma60 = 0", "价格低于 60 日均线"),
]


def to_wide(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per entity and date, one column per factor (a fixed list, so one pass)."""
    cells = [F.expr(f"max(CASE WHEN factor_name = '{n}' THEN factor_value END) AS {n}") for n in names]
    return long.groupBy("entity", "trade_date").agg(*cells)


def passes_filters(prefix: str = "") -> str:
    """SQL: every hard filter is present and zero."""
    return " AND ".join(f"coalesce({prefix}{n} = 0, false)" for n in HARD_FILTERS)


def top_per_date(wide: DataFrame, sort_factor: str, top_n: int) -> DataFrame:
    """Best N per date in the factor's direction, ties by entity.

    Spark keeps only N rows per date and task before the shuffle.
    """
    order = "ASC" if direction(sort_factor) == "lower_is_better" else "DESC"
    return (
        wide.filter(f"{sort_factor} IS NOT NULL")
        .selectExpr("*", f"row_number() OVER (PARTITION BY trade_date ORDER BY {sort_factor} {order}, entity) AS rank")
        .filter(f"rank <= {top_n}")
    )


def scan(wide: DataFrame, sort_factor: str, top_n: int) -> DataFrame:
    return top_per_date(wide.filter(passes_filters()), sort_factor, top_n)


def enrich(rows: DataFrame, securities: DataFrame, industries_on_dates: DataFrame) -> DataFrame:
    """Name and first industry known on the row's date."""
    names = first_per_key(securities.select("entity", "list_date", "name"), ["entity"], ["list_date", "name"])
    listed = names.selectExpr("entity", "list_date AS _listed", "name AS _name")
    first = first_per_key(
        industries_on_dates.select("entity", "trade_date", "in_date", "industry_l1", "industry_l2"),
        ["entity", "trade_date"],
        ["in_date", "industry_l1", "industry_l2"],
    ).drop("in_date")
    return (
        rows.join(listed, "entity", "left")
        .join(first, ["entity", "trade_date"], "left")
        .selectExpr(
            *rows.columns, "CASE WHEN _listed <= trade_date THEN _name END AS name", "industry_l1", "industry_l2"
        )
    )


def risk_tips(display: Sequence[str], available: Sequence[str]) -> str:
    """SQL for the joined risk hints of a wide factor row."""
    absent = ", ".join(f"CASE WHEN {n} IS NULL THEN '{n}' END" for n in display)
    missing = f"concat('{MISSING_TEXT}', nullif(concat_ws(', ', {absent}), ''))"
    rules = [
        f"CASE WHEN {rule} THEN '{text}' END" for rule, text in TIPS if rule.split()[0] in available
    ]
    return f"coalesce(nullif(concat_ws('；', {', '.join([missing, *rules])}), ''), '{NO_RISK_TEXT}')"


def scan_reason(sort_factor: str, top_n: int) -> str:
    d = direction(sort_factor)
    return (
        f"format_string('按 {sort_factor} {d} 排序进入 Top {top_n}；{sort_factor}=%.4f；硬过滤均通过。', {sort_factor})"
    )


def candidate_frame(enriched: DataFrame, sort_factor: str, display: Sequence[str], top_n: int, run_id: str) -> DataFrame:
    return enriched.selectExpr(
        "rank", "entity", "name", "industry_l1", "industry_l2", "trade_date AS as_of_date",
        f"'{run_id}' AS source_run_id", f"'{sort_factor}' AS sort_factor", f"{sort_factor} AS sort_factor_value",
        *[f"{n} AS factor__{n}" for n in display],
        *[f"{n} AS hard_filter__{n}" for n in HARD_FILTERS],
        f"{scan_reason(sort_factor, top_n)} AS selection_reason",
        f"{risk_tips(display, display)} AS risk_tips",
    )


def latest_versions(store: DataFrame, known_on: str) -> DataFrame:
    """Per key the newest version known on a date (``as_of_date <= known_on``).

    Two rows of the newest version fail the query; see :func:`repeated_versions` for all of them.
    """
    key = ["source_run_id", "entity", "trade_date", "factor_name"]
    known = store.filter(f"as_of_date <= DATE'{known_on}'")
    counted = known.groupBy(*key, "as_of_date").agg(F.expr("count(*) AS _n"), F.expr("min(factor_value) AS factor_value"))
    newest = first_per_key(counted, key, ["as_of_date DESC"])
    rule = "CASE WHEN _n > 1 THEN CAST(raise_error('several rows of one factor version') AS DOUBLE) ELSE factor_value END"
    return newest.withColumn("factor_value", F.expr(rule)).select(*store.columns)


def repeated_versions(store: DataFrame) -> DataFrame:
    """Keys and versions with more than one row, with their counts."""
    keys = ["source_run_id", "entity", "trade_date", "factor_name", "as_of_date"]
    return store.groupBy(*keys).agg(F.expr("count(*) AS row_count")).filter("row_count > 1")


def dates_with_rows(signals: DataFrame, store: DataFrame) -> DataFrame:
    return signals.join(store.selectExpr("trade_date AS signal_date"), "signal_date", "left_semi")


def equal_weight_targets(wide: DataFrame, sort_factor: str, top_n: int) -> DataFrame:
    """Targets of every signal date with weight 1 / selected."""
    picked = scan(wide, sort_factor, top_n)
    # At most N rows per date are left, so this window is bounded by the report size.
    return picked.selectExpr(
        "trade_date AS signal_date", "entity", "rank", f"{sort_factor} AS sort_factor_value",
        "1.0D / count(*) OVER (PARTITION BY trade_date) AS target_weight",
    )
