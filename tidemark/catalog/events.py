"""H: event study."""

from __future__ import annotations

from tidemark.catalog.registry import cte, query
from tidemark.functions.calendar import open_days
from tidemark.operators import asof
from tidemark.operators import events as ev

TYPES = ["1-URGENT", "2-HIGH"]
RISK_TYPES = ["P"]
START, END = "1996-01-01", "2001-06-30"
HORIZONS = [1, 5, 20]
PARSED_TYPES = ["llm_sentiment_positive", "llm_sentiment_negative", "llm_risk_detected", "llm_catalyst_detected"]
_BETWEEN = f"effective_date BETWEEN DATE '{START}' AND DATE '{END}'"

cte(
    "ev",
    f"""SELECT 'announcements' AS event_source, CAST(announcement_id AS VARCHAR) AS event_id, entity,
               announcement_type AS event_type, effective_date AS event_date, publish_time, effective_date, source,
               source_tag, title
        FROM announcements WHERE {_BETWEEN} AND announcement_type IN ('1-URGENT', '2-HIGH')""",
    ["announcements"],
)
cte(
    "rev",
    f"""SELECT 'risk_events' AS event_source, CAST(event_id AS VARCHAR) AS event_id, entity, event_type,
               effective_date AS event_date, publish_time, effective_date, source, CAST(NULL AS VARCHAR) AS source_tag,
               CAST(NULL AS VARCHAR) AS title
        FROM riskevents WHERE {_BETWEEN} AND event_type IN ('P')""",
    ["riskevents"],
)
cte(
    "dedup",
    """SELECT *, rn = 1 AS included, CASE WHEN rn = 1 THEN '' ELSE 'duplicate_same_stock_date_type' END AS skip_reason
       FROM (SELECT *, row_number() OVER (PARTITION BY entity, effective_date, event_type
                                          ORDER BY publish_time, source_tag NULLS LAST, event_id) AS rn FROM ev)""",
    ["ev"],
)
cte(
    "rets",
    f"""SELECT a.entity, a.trade_date AS event_date, h.horizon, p.trade_date AS future_price_date,
               (b.close * coalesce(b.adj_factor, 1.0)) / (a.close * coalesce(a.adj_factor, 1.0)) - 1 AS event_return
        FROM panel a JOIN gords o ON o.trade_date = a.trade_date
        CROSS JOIN (VALUES {', '.join(f'({h})' for h in HORIZONS)}) h(horizon)
        JOIN gords p ON p.ord = o.ord + h.horizon
        JOIN panel b ON b.entity = a.entity AND b.trade_date = p.trade_date
        WHERE a.close > 0 AND b.close > 0""",
    ["panel", "gords"],
)
cte(
    "gords",
    "SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS ord FROM calgap WHERE is_open",
    ["calgap"],
)
cte(
    "wins",
    """SELECT e.event_source, e.event_id, e.entity, e.event_type, e.event_date, r.horizon, r.event_return, r.future_price_date
       FROM dedup e JOIN rets r ON r.entity = e.entity AND r.event_date = e.event_date WHERE e.included""",
    ["dedup", "rets"],
)
cte(
    "bench",
    """SELECT r.event_date, r.horizon, avg(r.event_return) AS equal_weight_return,
              coalesce(sum(cap * r.event_return) / nullif(sum(cap), 0), avg(r.event_return)) AS cap_weight_return
       FROM (SELECT DISTINCT event_date FROM dedup) d
       JOIN universe_all u ON u.trade_date = d.event_date
       JOIN rets r ON r.entity = u.entity AND r.event_date = d.event_date
       LEFT JOIN (SELECT entity, trade_date, CASE WHEN float_mv > 0 THEN float_mv WHEN total_mv > 0 THEN total_mv END AS cap
                  FROM panel) c ON c.entity = u.entity AND c.trade_date = d.event_date
       GROUP BY 1, 2""",
    ["dedup", "universe_all", "rets", "panel"],
)
cte(
    "excess",
    """SELECT w.*, b.equal_weight_return AS benchmark_return, w.event_return - b.equal_weight_return AS excess_return
       FROM wins w LEFT JOIN bench b ON b.event_date = w.event_date AND b.horizon = w.horizon""",
    ["wins", "bench"],
)
cte(
    "samples",
    """SELECT e.event_source, e.event_id, e.entity, e.event_type, e.event_date, e.publish_time, e.effective_date,
              e.source, e.source_tag, e.title,
              CASE WHEN NOT e.included THEN e.skip_reason
                   WHEN p.close IS NULL OR p.close <= 0 THEN 'missing_event_date_price'
                   WHEN o.trade_date IS NULL THEN 'event_date_not_open'
                   WHEN m.mx IS NULL THEN 'insufficient_future_window' ELSE '' END AS skip_reason, m.mx
       FROM dedup e LEFT JOIN panel p ON p.entity = e.entity AND p.trade_date = e.event_date
       LEFT JOIN gords o ON o.trade_date = e.event_date
       LEFT JOIN (SELECT entity, event_date, max(horizon) AS mx FROM rets GROUP BY 1, 2) m
         ON m.entity = e.entity AND m.event_date = e.event_date""",
    ["dedup", "panel", "gords", "rets"],
)
cte(
    "evsum",
    """SELECT event_source, event_type, horizon, count(*) AS sample_count, avg(event_return) AS mean_event_return,
              median(event_return) AS median_event_return,
              avg(CASE WHEN event_return > 0 THEN 1.0 WHEN event_return <= 0 THEN 0.0 END) AS win_rate,
              avg(benchmark_return) AS mean_benchmark_return, avg(excess_return) AS mean_excess_return,
              median(excess_return) AS median_excess_return,
              avg(CASE WHEN excess_return > 0 THEN 1.0 WHEN excess_return <= 0 THEN 0.0 END) AS excess_win_rate,
              quantile_cont(excess_return, 0.25) AS p25_excess_return, quantile_cont(excess_return, 0.75) AS p75_excess_return
       FROM excess GROUP BY 1, 2, 3""",
    ["excess"],
)
_SUM_DOUBLES = (
    "mean_event_return median_event_return win_rate mean_benchmark_return mean_excess_return median_excess_return "
    "excess_win_rate p25_excess_return p75_excess_return"
)


def events(t):
    return ev.announcement_events(t.announcements, TYPES, START, END)


def returns(t):
    return ev.panel_returns(t.prices, t.calendar_gaps, HORIZONS)


def windows(t):
    return ev.window_returns(ev.deduplicate(events(t)), returns(t), t.calendar_gaps, HORIZONS)


def benchmark(t):
    members = asof.intervals_on_dates(t.members, open_days(t.calendar))
    return ev.benchmark_returns(events(t), members, returns(t), t.valuations)


def excess(t):
    """Windows with their excess returns, stored for all event summaries."""
    return t.stored("event_excess", lambda: ev.with_excess(windows(t), benchmark(t)))


@query("h1_announcement_and_risk_events", "SELECT * FROM ev UNION ALL SELECT * FROM rev", ["ev", "rev"])
def _(t):
    return events(t).unionByName(ev.risk_events(t.risk_events, RISK_TYPES, START, END))


@query(
    "h2_parsed_text_events",
    f"""
    SELECT 'announcement_results' AS event_source, parse_id || ':' || event_type AS event_id, entity, event_type,
           effective_date AS event_date, publish_time, effective_date, source, r_tag AS source_tag, title
    FROM (SELECT *, sha1('run|' || coalesce(source_tag, '') || '|' || CAST(announcement_id AS VARCHAR)) AS parse_id,
                 CASE WHEN announcement_id % 7 = 0 THEN NULL WHEN announcement_id % 13 = 0 THEN 'other' ELSE source_tag END AS r_tag,
                 unnest(['llm_sentiment_positive', 'llm_sentiment_negative', 'llm_risk_detected', 'llm_catalyst_detected']) AS event_type
          FROM announcements WHERE announcement_id % 9 <> 0 AND {_BETWEEN} AND 0.5 + (announcement_id % 50) / 100.0 >= 0.7)
    WHERE (source_tag = r_tag OR source_tag IS NULL OR r_tag IS NULL)
      AND CASE event_type WHEN 'llm_sentiment_positive' THEN announcement_id % 4 = 0
                          WHEN 'llm_sentiment_negative' THEN announcement_id % 4 = 1
                          WHEN 'llm_risk_detected' THEN announcement_id % 17 <> 0 AND announcement_id % 3 = 0
                          ELSE announcement_id % 17 <> 0 AND announcement_id % 8 = 0 END
    """,
    ["announcements"],
)
def _(t):
    return ev.parsed_text_events(t.parsed_results, t.announcements, PARSED_TYPES, START, END, 0.7)


@query(
    "h3_duplicate_groups",
    """SELECT *, CASE WHEN count(*) OVER (PARTITION BY entity, effective_date, event_type) > 1
                 THEN 'dup-' || substr(sha1(entity || '|' || CAST(effective_date AS VARCHAR) || '|' || event_type), 1, 10)
                 ELSE '' END AS duplicate_group_id FROM ev""",
    ["ev"],
)
def _(t):
    return ev.mark_duplicates(events(t))


@query("h4_deduplicate_events", "SELECT * EXCLUDE (rn) FROM dedup", ["dedup"])
def _(t):
    return ev.deduplicate(events(t))


@query("h5_event_windows", "SELECT * FROM wins", ["wins"], doubles="event_return", longs="horizon")
def _(t):
    return windows(t)


@query(
    "h6_classified_samples",
    """SELECT * EXCLUDE (mx), skip_reason = '' AS included,
              CAST(CASE WHEN skip_reason = '' THEN mx ELSE 0 END AS BIGINT) AS available_max_horizon FROM samples""",
    ["samples"],
)
def _(t):
    return ev.classify(ev.deduplicate(events(t)), t.prices, t.calendar_gaps, returns(t))


@query(
    "h7_benchmark_returns",
    "SELECT * FROM bench",
    ["bench"],
    doubles="equal_weight_return cap_weight_return",
    longs="horizon",
)
def _(t):
    return benchmark(t)


@query(
    "h8_excess_returns",
    "SELECT * FROM excess",
    ["excess"],
    doubles="event_return benchmark_return excess_return",
    longs="horizon",
)
def _(t):
    return excess(t)


@query("h9_event_summary", "SELECT * FROM evsum", ["evsum"], doubles=_SUM_DOUBLES, longs="horizon")
def _(t):
    return ev.summarize(excess(t))


@query(
    "h10_skip_counts",
    "SELECT skip_reason, count(*) AS row_count FROM samples WHERE skip_reason <> '' GROUP BY 1",
    ["samples"],
)
def _(t):
    return ev.skip_counts(ev.classify(ev.deduplicate(events(t)), t.prices, t.calendar_gaps, returns(t)))


@query(
    "h10_small_sample_flag",
    "SELECT event_source, event_type, horizon, sample_count, sample_count < 5 AS small_sample FROM evsum",
    ["evsum"],
    longs="horizon",
)
def _(t):
    summary = ev.summarize(excess(t))
    return ev.small_samples(summary).select("event_source", "event_type", "horizon", "sample_count", "small_sample")
