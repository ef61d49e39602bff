"""Event study over announcements, risk events and parsed-text events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import target_dates
from tidemark.functions.ranks import first_per_key, several_quantiles
from tidemark.operators.factors import STRICT_ADJUSTED_CLOSE
from tidemark.operators.validation import forward_labels
from tidemark.session import materialize

EVENT_KEY = ["entity", "effective_date", "event_type"]
SMALL_SAMPLE = 5
RESULT_SCHEMA = "risks ARRAY<STRING>, catalysts ARRAY<STRING>"


def _range(start: str, end: str) -> str:
    return f"effective_date BETWEEN DATE'{start}' AND DATE'{end}'"


def announcement_events(announcements: DataFrame, types: Sequence[str], start: str, end: str) -> DataFrame:
    return (
        announcements.filter(_range(start, end))
        .filter(F.col("announcement_type").isin(list(types)))
        .selectExpr(
            "'announcements' AS event_source", "CAST(announcement_id AS STRING) AS event_id", "entity",
            "announcement_type AS event_type", "effective_date AS event_date", "publish_time", "effective_date",
            "source", "source_tag", "title",
        )
    )


def risk_events(events: DataFrame, types: Sequence[str], start: str, end: str) -> DataFrame:
    return events.filter(_range(start, end)).filter(F.col("event_type").isin(list(types))).selectExpr(
        "'risk_events' AS event_source", "CAST(event_id AS STRING) AS event_id", "entity", "event_type",
        "effective_date AS event_date", "publish_time", "effective_date", "source",
        "CAST(NULL AS STRING) AS source_tag", "CAST(NULL AS STRING) AS title",
    )


def json_list_filled(column: str, field: str) -> str:
    """SQL: the JSON object has a non-empty list under ``field``; bad JSON is false."""
    return f"coalesce(size(from_json({column}, '{RESULT_SCHEMA}').{field}) > 0, false)"


def parsed_text_events(
    results: DataFrame, announcements: DataFrame, types: Sequence[str], start: str, end: str, min_confidence: float
) -> DataFrame:
    """Up to four event types per successful extraction.

    The join is on the announcement id with compatible source tags: equal, or
    one of them missing.
    """
    a = announcements.selectExpr(
        "announcement_id", "title", "publish_time", "effective_date", "source_tag AS a_tag"
    ).filter(_range(start, end))
    # Event type names.
    flags = (
        "array_compact(array("
        "CASE WHEN lower(sentiment) = 'positive' THEN 'llm_sentiment_positive' END, "
        "CASE WHEN lower(sentiment) = 'negative' THEN 'llm_sentiment_negative' END, "
        f"CASE WHEN {json_list_filled('parsed_json', 'risks')} THEN 'llm_risk_detected' END, "
        f"CASE WHEN {json_list_filled('parsed_json', 'catalysts')} THEN 'llm_catalyst_detected' END))"
    )
    return (
        results.filter(f"status = 'success' AND confidence >= {float(min_confidence)}D")
        .join(a, "announcement_id")
        .filter("a_tag = source_tag OR a_tag IS NULL OR source_tag IS NULL")
        .selectExpr("*", f"explode({flags}) AS event_type")
        .filter(F.col("event_type").isin(list(types)))
        .selectExpr(
            "'announcement_results' AS event_source", "concat(parse_id, ':', event_type) AS event_id", "entity",
            "event_type", "effective_date AS event_date", "publish_time", "effective_date", "source", "source_tag",
            "title",
        )
    )


def mark_duplicates(events: DataFrame) -> DataFrame:
    """Group id for events that share entity, effective date and type; empty when alone."""
    sizes = events.groupBy(*EVENT_KEY).agg(F.expr("count(event_id) AS _n"))
    group = "concat('dup-', substring(sha1(concat_ws('|', entity, effective_date, event_type)), 1, 10))"
    return events.join(sizes, EVENT_KEY).selectExpr(
        *events.columns, f"CASE WHEN _n > 1 THEN {group} ELSE '' END AS duplicate_group_id"
    )


def deduplicate(events: DataFrame) -> DataFrame:
    """Keep the first event per key; the others carry a skip reason."""
    first = first_per_key(
        events.select(*EVENT_KEY, "publish_time", "source_tag", "event_id"),
        EVENT_KEY,
        ["publish_time", "source_tag", "event_id"],
    ).selectExpr(*EVENT_KEY, "event_id AS _first")
    return events.join(first, EVENT_KEY).selectExpr(
        *events.columns,
        "event_id = _first AS included",
        "CASE WHEN event_id = _first THEN '' ELSE 'duplicate_same_stock_date_type' END AS skip_reason",
    )


def panel_returns(prices: DataFrame, calendar: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Returns of every entity from each open day to the h-th next open day."""
    strict = prices.selectExpr("entity", "trade_date", f"{STRICT_ADJUSTED_CLOSE} AS close", "1.0D AS adj_factor")
    opens = calendar.filter("is_open").select("trade_date").distinct()
    labels = forward_labels(strict, calendar, horizons).join(opens, "trade_date", "left_semi")
    return labels.selectExpr("entity", "trade_date AS event_date", "horizon", "forward_return AS event_return")


def window_returns(events: DataFrame, returns: DataFrame, calendar: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Event × horizon returns; a missing future price leaves the horizon out."""
    targets = target_dates(
        calendar.filter("is_open").select("trade_date"), list(horizons), calendar
    ).selectExpr("trade_date AS event_date", "horizon", "target_date AS future_price_date")
    return (
        events.filter("included")
        .select("event_source", "event_id", "entity", "event_type", "event_date")
        .join(returns, ["entity", "event_date"])
        .join(targets, ["event_date", "horizon"])
    )


def classify(events: DataFrame, prices: DataFrame, calendar: DataFrame, returns: DataFrame) -> DataFrame:
    """Final samples: inclusion, reason in fixed precedence, longest usable horizon."""
    px = prices.selectExpr("entity", "trade_date AS event_date", f"{STRICT_ADJUSTED_CLOSE} AS _price")
    opens = calendar.filter("is_open").selectExpr("trade_date AS event_date", "true AS _open").distinct()
    usable = returns.groupBy("entity", "event_date").agg(F.expr("max(horizon) AS _max"))
    reason = (
        "CASE WHEN NOT included THEN skip_reason WHEN _price IS NULL THEN 'missing_event_date_price' "
        "WHEN _open IS NULL THEN 'event_date_not_open' WHEN _max IS NULL THEN 'insufficient_future_window' ELSE '' END"
    )
    return (
        events.join(px, ["entity", "event_date"], "left")
        .join(opens, "event_date", "left")
        .join(usable, ["entity", "event_date"], "left")
        .selectExpr(*[c for c in events.columns if c not in ("included", "skip_reason")], f"{reason} AS skip_reason", "_max")
        .selectExpr("*", "skip_reason = '' AS included", "CASE WHEN skip_reason = '' THEN _max ELSE 0 END AS available_max_horizon")
        .drop("_max")
    )


def benchmark_returns(
    event_dates: DataFrame, members_on_dates: DataFrame, returns: DataFrame, valuations: DataFrame
) -> DataFrame:
    """Equal- and cap-weighted basket return per event date and horizon.

    Computed once per date pair.  The cap falls through to ``total_mv`` when
    ``float_mv`` is missing or not positive; without caps the mean is used.
    """
    caps = valuations.selectExpr(
        "entity",
        "trade_date AS event_date",
        "CASE WHEN float_mv > 0 THEN float_mv WHEN total_mv > 0 THEN total_mv END AS cap",
    )
    basket = (
        members_on_dates.selectExpr("entity", "trade_date AS event_date")
        .distinct()
        .join(event_dates.select("event_date").distinct(), "event_date", "left_semi")
    )
    return (
        basket.join(returns, ["entity", "event_date"])
        .join(caps, ["entity", "event_date"], "left")
        .groupBy("event_date", "horizon")
        .agg(
            F.expr("avg(event_return) AS equal_weight_return"),
            F.expr(
                "coalesce(try_divide(sum(cap * event_return), sum(cap)), avg(event_return)) AS cap_weight_return"
            ),
        )
    )


def with_excess(windows: DataFrame, benchmark: DataFrame, column: str = "equal_weight_return") -> DataFrame:
    bench = benchmark.selectExpr("event_date", "horizon", f"{column} AS benchmark_return")
    return windows.join(bench, ["event_date", "horizon"], "left").selectExpr(
        "*", "event_return - benchmark_return AS excess_return"
    )


def summarize(windows: DataFrame) -> DataFrame:
    """Sample statistics per source, type and horizon."""
    keys = ["event_source", "event_type", "horizon"]
    base = windows.groupBy(*keys).agg(
        F.expr("count(*) AS sample_count"),
        F.expr("avg(event_return) AS mean_event_return"),
        F.expr("avg(CAST(event_return > 0 AS INT)) AS win_rate"),
        F.expr("avg(benchmark_return) AS mean_benchmark_return"),
        F.expr("avg(excess_return) AS mean_excess_return"),
        F.expr("avg(CAST(excess_return > 0 AS INT)) AS excess_win_rate"),
    )
    # Both columns and all points in one pass over a written table, whose largest group is known from the counts.
    points = {
        "event_return": {"median_event_return": 0.5},
        "excess_return": {"p25_excess_return": 0.25, "median_excess_return": 0.5, "p75_excess_return": 0.75},
    }
    base = materialize(base)
    largest = base.agg(F.max("sample_count")).first()[0] or 0
    return base.join(several_quantiles(windows, keys, points, largest=largest), keys, "left")


def skip_counts(samples: DataFrame) -> DataFrame:
    return samples.filter("NOT included").groupBy("skip_reason").agg(F.expr("count(*) AS row_count"))


def small_samples(summary: DataFrame) -> DataFrame:
    return summary.selectExpr("*", f"sample_count < {SMALL_SAMPLE} AS small_sample")
