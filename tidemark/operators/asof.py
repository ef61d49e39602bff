"""What was known on a date: visibility rules for panels, facts and intervals.

* panel rows: ``trade_date <= D``
* published facts: publication day and effective date both ``<= D``
* intervals: entered (business and knowledge date) on or before D, and not yet
  left, where an exit counts only once both its business date and its knowledge
  date have passed
* an exit that is not yet known on D shows as NULL in all exit columns
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import day_key, dense_days, ordinals

EXIT_COLUMNS = ("out_date", "out_publish", "out_effective")

# SQL of the visibility rules.
VISIBLE_FROM = "greatest(in_date, coalesce(in_effective, in_date))"
# First day an interval is no longer active; NULL while it is open.
VISIBLE_UNTIL = "CASE WHEN out_date IS NOT NULL THEN greatest(out_date, coalesce(out_effective, out_date)) END"
# First day a security counts as delisted; NULL when it has no delisting.
DELISTED_FROM = "CASE WHEN delist_date IS NOT NULL THEN greatest(delist_date, coalesce(delist_effective, delist_date)) END"
PUBLISHED_FROM = "greatest(to_date(publish_time), effective_date)"


def _where_equal(df: DataFrame, equals: dict[str, object]) -> DataFrame:
    for name, value in equals.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def panel_as_of(panel: DataFrame, day: date | str, **equals: object) -> DataFrame:
    return _where_equal(panel.filter(f"trade_date <= DATE'{day}'"), equals)


def published_as_of(facts: DataFrame, day: date | str, **equals: object) -> DataFrame:
    visible = facts.filter(f"to_date(publish_time) <= DATE'{day}' AND effective_date <= DATE'{day}'")
    return _where_equal(visible, equals)


def mask_exit(df: DataFrame, day: str) -> DataFrame:
    """Show exit columns only when the exit is known on ``day`` (SQL text)."""
    masked = "CASE WHEN coalesce(out_effective, out_date) <= {0} THEN {1} END AS {1}"
    return df.selectExpr(
        *[masked.format(day, f"`{c}`") if c in EXIT_COLUMNS else f"`{c}`" for c in df.columns]
    )


def intervals_as_of(intervals: DataFrame, day: date | str, **equals: object) -> DataFrame:
    """Active intervals on one date with unknown exits masked."""
    d = f"DATE'{day}'"
    active = f"{VISIBLE_FROM} <= {d} AND coalesce({d} < {VISIBLE_UNTIL}, true)"
    return mask_exit(_where_equal(intervals.filter(active), equals), d)


def members_as_of(
    members: DataFrame,
    day: date | str,
    index_code: str | None = None,
    source_tag: str | None = None,
    historical_only: bool = False,
) -> DataFrame:
    out = intervals_as_of(members, day, index_code=index_code)
    if source_tag is not None:
        out = out.filter(F.coalesce("source_tag", "source") == F.lit(source_tag))
    if historical_only:
        out = out.filter("coalesce(universe_kind, 'unknown') = 'historical_pit'")
    return out


def securities_as_of(securities: DataFrame, day: date | str, include_delisted: bool = False) -> DataFrame:
    d = f"DATE'{day}'"
    known = f"CASE WHEN coalesce(delist_effective, delist_date) <= {d} THEN {{0}} END AS {{0}}"
    out = securities.filter(f"list_date <= {d}").withColumn(
        "is_delisted_as_of", F.expr(f"coalesce({DELISTED_FROM} <= {d}, false)")
    )
    if not include_delisted:
        out = out.filter("NOT is_delisted_as_of")
    dates = ("delist_date", "delist_publish", "delist_effective")
    return out.selectExpr(*[known.format(c) if c in dates else c for c in out.columns])


def snapshot(tables, day: date | str) -> dict[str, DataFrame]:
    """All nine tables as known on one date."""
    return {
        "daily_prices": panel_as_of(tables.prices, day),
        "valuation_daily": panel_as_of(tables.valuations, day),
        "universe_members": members_as_of(tables.members, day),
        "securities": securities_as_of(tables.securities, day),
        "st_status": intervals_as_of(tables.st_status, day),
        "industry_classifications": intervals_as_of(tables.industries, day),
        "fundamental_reports": published_as_of(tables.fundamentals, day),
        "announcements": published_as_of(tables.announcements, day),
        "risk_events": published_as_of(tables.risk_events, day),
    }


def snapshot_summary(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows and distinct entities per table of a snapshot."""
    out = None
    for name, df in frames.items():
        # Rows per entity first: a distinct count over one big key set stays distributed.
        row = (
            df.groupBy("entity")
            .agg(F.expr("count(*) AS n"))
            .agg(
                F.expr(f"'{name}' AS table_name"),
                F.expr("coalesce(sum(n), 0) AS row_count"),
                F.expr("count(entity) AS entity_count"),
            )
        )
        out = row if out is None else out.unionByName(row)
    return out


# ---- many dates at once -------------------------------------------------


def spans(df: DataFrame, start: str, until: str | None, dates: DataFrame) -> DataFrame:
    """The half-open range [start, until) of each row as its first and last position (``_first, _last``) in the sorted list of dates.

    Rows without a requested date in their range are left out.  ``start`` and ``until`` are SQL text; a NULL ``until`` means still open.
    One row per interval, whatever the number of dates: joins and aggregates that need no date work on these, see :func:`merge_spans`
    and :func:`count_spans`, and :func:`expand` comes last.
    """
    wanted = _wanted(dates)
    days = dense_days(wanted, ["upto"])
    first = days.selectExpr("day AS _d1", "upto AS _before")
    last = days.selectExpr("day AS _d2", "upto AS _end")
    keyed = df.selectExpr("*", f"{start} AS _from", f"{until or 'CAST(NULL AS DATE)'} AS _until").withColumns(
        {"_k1": day_key("date_sub(_from, 1)", wanted), "_k2": day_key("date_sub(_until, 1)", wanted)}
    )
    # An open end reaches to the last requested position.
    return (
        keyed.join(first, F.expr("_k1 = _d1"))
        .join(last, F.expr("_k2 = _d2"), "left")
        .withColumn("_last", F.when(F.col("_until").isNull(), wanted.agg(F.expr("count(*)")).scalar()).otherwise(F.col("_end")))
        .filter("_last > _before")
        .selectExpr(*[f"`{c}`" for c in df.columns], "_before + 1 AS _first", "_last")
    )


def _wanted(dates: DataFrame) -> DataFrame:
    return dates.selectExpr(f"{dates.columns[0]} AS trade_date", "true AS is_open").filter("trade_date IS NOT NULL").distinct()


def merge_spans(placed: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, _first, _last``: the spans of equal keys joined where they overlap or touch, so that no position occurs twice for a key.

    Sweeps over the intervals of a key, not over its dates.
    """
    by = ", ".join(f"`{k}`" for k in keys)
    opens = f"coalesce(_first > 1 + max(_last) OVER (PARTITION BY {by} ORDER BY _first, _last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)"
    numbered = placed.selectExpr(*[f"`{k}`" for k in keys], "_first", "_last", f"{opens} AS _opens").selectExpr(
        "*", f"sum(CAST(_opens AS INT)) OVER (PARTITION BY {by} ORDER BY _first, _last ROWS UNBOUNDED PRECEDING) AS _run"
    )
    return numbered.groupBy(*keys, "_run").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last")).drop("_run")


def count_spans(placed: DataFrame, by: list[str], dates: DataFrame, out: str = "row_count") -> DataFrame:
    """``by, trade_date, out``: the number of spans on each requested date, for dates with at least one.

    A span adds one at its first position and takes it back after its last; equal steps are summed before the shuffle, and the running total holds
    from one step to the next.  Only the totals meet the dates, so nothing has a row per span and date.
    """
    steps = (
        placed.selectExpr(*[f"`{c}`" for c in by], "inline(array(struct(_first AS _at, 1L AS _step), struct(_last + 1 AS _at, -1L AS _step)))")
        .groupBy(*by, "_at")
        .agg(F.sum("_step").alias("_step"))
    )
    keys = f"PARTITION BY {', '.join(f'`{c}`' for c in by)} " if by else ""
    totals = steps.selectExpr(
        *[f"`{c}`" for c in by], f"sum(_step) OVER ({keys}ORDER BY _at ROWS UNBOUNDED PRECEDING) AS `{out}`", "_at AS _first",
        f"lead(_at) OVER ({keys}ORDER BY _at) - 1 AS _last",
    )
    return expand(totals.filter(f"`{out}` > 0"), dates)


def expand(placed: DataFrame, dates: DataFrame, out: str = "trade_date", by: list[str] | None = None) -> DataFrame:
    """One row per position of each span, with its date.

    Spans are a few bytes for hundreds of dates, so adaptive execution would put them all into one task.  They are spread first: evenly,
    or by ``by``, where the caller knows that such a key has at most one row per date.
    """
    columns = [f"`{c}`" for c in placed.columns if c not in ("_first", "_last")]
    partitions = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = placed.repartition(partitions, *[f"`{k}`" for k in by or []])
    rows = spread.selectExpr(*columns, "explode(sequence(_first, _last)) AS _ord")
    return rows.join(ordinals(_wanted(dates), out, "_ord"), "_ord").drop("_ord")


def on_dates(df: DataFrame, start: str, until: str | None, dates: DataFrame, out: str = "trade_date") -> DataFrame:
    """One row per requested date in the half-open range [start, until).

    Each row looks up its first and last position in the sorted list of dates
    and emits exactly the dates between them, so no range join is planned and
    nothing but the result is produced.  ``start`` and ``until`` are SQL text;
    a NULL ``until`` means still open.
    """
    return expand(spans(df, start, until, dates), dates, out)


def keys_on_dates(df: DataFrame, keys: list[str], start: str, until: str | None, dates: DataFrame) -> DataFrame:
    """Distinct ``keys, trade_date`` of the ranges; made distinct as merged spans, before there are rows per date."""
    placed = spans(df.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)), start, until, dates)
    return expand(merge_spans(placed, keys), dates, by=keys)


def active_on_dates(intervals: DataFrame, keys: list[str], dates: DataFrame) -> DataFrame:
    """Distinct ``keys, trade_date`` with an active interval."""
    return keys_on_dates(intervals, keys, VISIBLE_FROM, VISIBLE_UNTIL, dates)


def active_counts(intervals: DataFrame, by: list[str], member: str, dates: DataFrame, out: str) -> DataFrame:
    """Distinct members of each ``by`` on each requested date."""
    placed = spans(intervals.filter(f"`{member}` IS NOT NULL"), VISIBLE_FROM, VISIBLE_UNTIL, dates)
    return count_spans(merge_spans(placed, [*by, member]), by, dates, out)


def intervals_on_dates(intervals: DataFrame, dates: DataFrame) -> DataFrame:
    """Active intervals on every requested date, exits masked per date."""
    return mask_exit(on_dates(intervals, VISIBLE_FROM, VISIBLE_UNTIL, dates), "trade_date")


def published_on_dates(facts: DataFrame, dates: DataFrame) -> DataFrame:
    """Facts visible on every requested date."""
    return on_dates(facts.filter("effective_date IS NOT NULL"), PUBLISHED_FROM, None, dates)


def latest_revisions(facts: DataFrame, key: list[str]) -> DataFrame:
    """Revision timeline: each row with the day it becomes visible and is replaced.

    Revisions that become visible on the same day collapse to the last one
    published, so a timeline never has more rows than days.
    """
    from tidemark.functions.ranks import first_per_key

    seen = facts.filter("effective_date IS NOT NULL").selectExpr("*", f"{PUBLISHED_FROM} AS visible_on")
    last = first_per_key(seen, [*key, "visible_on"], ["publish_time DESC"])
    keys = ", ".join(key)
    return last.selectExpr(
        "*", f"lead(visible_on) OVER (PARTITION BY {keys} ORDER BY visible_on) AS replaced_on"
    )
