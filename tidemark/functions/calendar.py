"""Trading-calendar arithmetic.

A calendar has one row per day, so its size is bounded by time and not by the
facts; the unpartitioned windows below run over at most a few ten thousand
rows.  Facts meet the calendar through equi-joins on a dense day table, never
through a range join.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def open_days(calendar: DataFrame, start: date | str | None = None, end: date | str | None = None) -> DataFrame:
    """Open trading dates, optionally inside a closed range."""
    rule = "is_open"
    if start is not None:
        rule += f" AND trade_date >= DATE'{start}'"
    if end is not None:
        rule += f" AND trade_date <= DATE'{end}'"
    return calendar.filter(rule).select("trade_date").distinct()


def ordinals(calendar: DataFrame, day: str = "trade_date", ord: str = "ord") -> DataFrame:
    """1-based ordinals of the open days."""
    return open_days(calendar).selectExpr(
        f"trade_date AS {day}", f"CAST(row_number() OVER (ORDER BY trade_date) AS BIGINT) AS {ord}"
    )


def _span(calendar: DataFrame) -> DataFrame:
    """One row: the day before the first and the day after the last open day."""
    return open_days(calendar).agg(
        F.expr("date_sub(min(trade_date), 1) AS lo"), F.expr("date_add(max(trade_date), 1) AS hi")
    )


def day_key(day: str, calendar: DataFrame) -> Column:
    """The day to look up in :func:`dense_days` of ``calendar``; NULL stays NULL.

    All days before the first open day have the same neighbours, and so have all days after the last one,
    so a day outside the table is looked up at its ends.
    """
    d, span = F.expr(f"to_date({day})"), _span(calendar)
    inside = F.least(F.greatest(d, span.select("lo").scalar()), span.select("hi").scalar())
    return F.when(d.isNotNull(), inside)


def dense_days(calendar: DataFrame, wanted: Sequence[str] = ("upto", "prev_open", "next_open")) -> DataFrame:
    """One row per day from before the first to after the last open day, with its open neighbours.

    ``upto`` counts open days <= day; ``prev_open`` and ``next_open`` are
    strictly before and after it.
    """
    opens = open_days(calendar).selectExpr("trade_date AS open_date")
    days = _span(calendar).selectExpr("explode(sequence(lo, hi)) AS day")
    # Looking forward is written as looking back over the reversed order: a frame
    # that ends at the last row would rescan the rest of the table for every row.
    shapes = {
        "upto": "count(open_date) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING)",
        "prev_open": "max(open_date) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
        "next_open": "min(open_date) OVER (ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    }
    return days.join(opens, F.expr("day = open_date"), "left").selectExpr(
        "day", *[f"{shapes[name]} AS {name}" for name in wanted]
    )


def next_open(facts: DataFrame, day: str, calendar: DataFrame, out: str) -> DataFrame:
    """Add the first open day strictly after ``day`` (NULL when there is none)."""
    lookup = dense_days(calendar, ["next_open"]).selectExpr("day AS _day", f"next_open AS {out}")
    key = facts.withColumn("_key", day_key(day, calendar))
    return key.join(lookup, F.expr("_key = _day"), "left").drop("_key", "_day")


def unplaced(facts: DataFrame, dataset: str, publish: str = "publish_time", effective: str = "effective_date") -> DataFrame:
    """One issue row if published facts have no effective date because no open day follows: they are not visible on any date."""
    return (
        facts.filter(f"{publish} IS NOT NULL AND {effective} IS NULL")
        .agg(
            F.expr(f"'{dataset}' AS dataset"), F.expr("'no_open_day_after_publication' AS issue"), F.expr("count(*) AS row_count"),
            F.expr(f"min({publish}) AS first_publish"), F.expr(f"max({publish}) AS last_publish"),
        )
        .filter("row_count > 0")
    )


def fill_effective(
    facts: DataFrame, effective: str, publish: str, fallback: str | None, calendar: DataFrame
) -> DataFrame:
    """Keep a given date, else next open day after publication, else the business date."""
    with_next = next_open(facts, publish, calendar, "_from_publish")
    rule = (
        f"CASE WHEN {effective} IS NOT NULL THEN {effective} WHEN {publish} IS NOT NULL THEN _from_publish "
        f"ELSE {fallback or 'CAST(NULL AS DATE)'} END"
    )
    return with_next.withColumn(effective, F.expr(rule)).drop("_from_publish")


def fill_neighbors(calendar: DataFrame) -> DataFrame:
    """Previous/next open date where missing; closed days stay NULL."""
    near = open_days(calendar).selectExpr(
        "trade_date",
        "lag(trade_date) OVER (ORDER BY trade_date) AS _prev",
        "lead(trade_date) OVER (ORDER BY trade_date) AS _next",
    )
    return (
        calendar.join(near, "trade_date", "left")
        .withColumns(
            {
                "prev_trade_date": F.expr("coalesce(prev_trade_date, _prev)"),
                "next_trade_date": F.expr("coalesce(next_trade_date, _next)"),
            }
        )
        .drop("_prev", "_next")
    )


def target_dates(signals: DataFrame, horizons: list[int], calendar: DataFrame) -> DataFrame:
    """``trade_date, horizon, target_date``: the h-th open day strictly after a signal day.

    The signal day itself may be closed.
    """
    days = dense_days(calendar, ["upto"])
    steps = ", ".join(f"{h}L" for h in horizons)
    wanted = (
        signals.select("trade_date")
        .distinct()
        .withColumn("_key", day_key("trade_date", calendar))
        .join(days, F.expr("_key = day"))
        .selectExpr("trade_date", "upto", f"explode(array({steps})) AS horizon")
        .selectExpr("trade_date", "horizon", "upto + horizon AS ord")
    )
    return wanted.join(ordinals(calendar, "target_date"), "ord").select("trade_date", "horizon", "target_date")


def month_ends(calendar: DataFrame, start: date | str | None = None, end: date | str | None = None) -> DataFrame:
    """Last open day of each month in a range."""
    return (
        open_days(calendar, start, end)
        .groupBy(F.expr("trunc(trade_date, 'month') AS month"))
        .agg(F.expr("max(trade_date) AS signal_date"))
    )


def is_open_on(calendar: DataFrame, day: date | str) -> DataFrame:
    """One row telling whether ``day`` is an open day (false when absent)."""
    return calendar.filter(f"trade_date = DATE'{day}'").agg(
        F.expr("count(*) AS calendar_rows"), F.expr("coalesce(bool_or(is_open), false) AS is_open")
    )
