"""D: point-in-time scans."""

from __future__ import annotations


from tidemark.catalog.registry import cte, query
from tidemark.functions.calendar import month_ends, open_days
from tidemark.operators import asof

DAY = "1999-06-07"
EXIT_DAY_U = "1999-12-30"  # exit already known, membership still running
EXIT_DAY_I = "1998-01-07"  # membership over, exit not yet known
EXIT_DAY_T = "1998-02-06"


def interval_sql(table: str, day: str, columns: str, where: str = "TRUE") -> str:
    return f"""
    SELECT {columns}, in_date, in_publish, in_effective,
           CASE WHEN coalesce(out_effective, out_date) <= DATE '{day}' THEN out_date END AS out_date,
           CASE WHEN coalesce(out_effective, out_date) <= DATE '{day}' THEN out_publish END AS out_publish,
           CASE WHEN coalesce(out_effective, out_date) <= DATE '{day}' THEN out_effective END AS out_effective
    FROM {table}
    WHERE in_date <= DATE '{day}' AND coalesce(in_effective, in_date) <= DATE '{day}'
      AND (out_date IS NULL OR DATE '{day}' < out_date OR coalesce(out_effective, out_date) > DATE '{day}')
      AND {where}
    """


def interval_dates_sql(table: str, columns: str, dates: str) -> str:
    """The same rule for every date of a date list (long form, for the SQL side)."""
    return f"""
    SELECT d.trade_date, {columns},
           CASE WHEN coalesce(t.out_effective, t.out_date) <= d.trade_date THEN t.out_date END AS out_date
    FROM {table} t JOIN {dates} d
      ON t.in_date <= d.trade_date AND coalesce(t.in_effective, t.in_date) <= d.trade_date
     AND (t.out_date IS NULL OR d.trade_date < t.out_date OR coalesce(t.out_effective, t.out_date) > d.trade_date)
    """


PRICE_COLS = "entity, trade_date, open, high, low, close, volume, amount, adj_factor, is_suspended, limit_up, limit_down"


@query(
    "d1_prices_as_of",
    f"SELECT {PRICE_COLS} FROM panel WHERE trade_date <= DATE '{DAY}'",
    ["panel"],
    doubles="open high low close volume amount adj_factor limit_up limit_down",
)
def _(t):
    return asof.panel_as_of(t.prices, DAY)


@query(
    "d2_valuations_as_of",
    f"SELECT entity, trade_date, pe_ttm, pb, total_mv, float_mv FROM panel WHERE trade_date <= DATE '{DAY}'",
    ["panel"],
    doubles="pe_ttm pb total_mv float_mv",
)
def _(t):
    return asof.panel_as_of(t.valuations, DAY)


@query(
    "d3_members_as_of",
    interval_sql("members", EXIT_DAY_U, "entity, index_code, source, source_tag, universe_kind", "index_code = 'X'"),
    ["members"],
)
def _(t):
    return asof.members_as_of(t.members, EXIT_DAY_U, index_code="X")


@query(
    "d3_historical_members_as_of",
    interval_sql(
        "members",
        EXIT_DAY_U,
        "entity, index_code, source, source_tag, universe_kind",
        "coalesce(source_tag, source) = 'main' AND coalesce(universe_kind, 'unknown') = 'historical_pit'",
    ),
    ["members"],
)
def _(t):
    return asof.members_as_of(t.members, EXIT_DAY_U, source_tag="main", historical_only=True)


SECURITIES_SQL = f"""
    SELECT entity, name, list_date,
           CASE WHEN coalesce(delist_effective, delist_date) <= DATE '{DAY}' THEN delist_date END AS delist_date,
           CASE WHEN coalesce(delist_effective, delist_date) <= DATE '{DAY}' THEN delist_publish END AS delist_publish,
           CASE WHEN coalesce(delist_effective, delist_date) <= DATE '{DAY}' THEN delist_effective END AS delist_effective,
           coalesce(delist_date <= DATE '{DAY}' AND coalesce(delist_effective, delist_date) <= DATE '{DAY}', FALSE)
             AS is_delisted_as_of
    FROM securities WHERE list_date <= DATE '{DAY}'
"""


@query("d4_securities_as_of", SECURITIES_SQL, ["securities"])
def _(t):
    return asof.securities_as_of(t.securities, DAY, include_delisted=True)


@query(
    "d4_listed_securities_as_of",
    f"SELECT entity, name, list_date, delist_date FROM ({SECURITIES_SQL}) WHERE NOT is_delisted_as_of",
    ["securities"],
)
def _(t):
    return asof.securities_as_of(t.securities, DAY).select("entity", "name", "list_date", "delist_date")


@query("d5_st_status_as_of", interval_sql("ststatus", EXIT_DAY_T, "entity, st_type"), ["ststatus"])
def _(t):
    return asof.intervals_as_of(t.st_status, EXIT_DAY_T)


@query(
    "d6_industries_as_of",
    interval_sql(
        "industries", EXIT_DAY_I, "entity, standard, industry_l1, industry_l2, version", "standard = 'std'"
    ),
    ["industries"],
)
def _(t):
    return asof.intervals_as_of(t.industries, EXIT_DAY_I, standard="std")


@query(
    "d7_fundamentals_as_of",
    f"SELECT * FROM fundamentals WHERE publish_time <= DATE '{DAY}' AND effective_date <= DATE '{DAY}'",
    ["fundamentals"],
    doubles="revenue net_profit operating_cashflow",
)
def _(t):
    return asof.published_as_of(t.fundamentals, DAY)


@query(
    "d8_announcements_as_of",
    f"""SELECT * FROM announcements WHERE publish_time <= DATE '{DAY}' AND effective_date <= DATE '{DAY}'
        AND announcement_type = '1-URGENT'""",
    ["announcements"],
)
def _(t):
    return asof.published_as_of(t.announcements, DAY, announcement_type="1-URGENT")


@query(
    "d9_risk_events_as_of",
    f"SELECT * FROM riskevents WHERE publish_time <= DATE '{DAY}' AND effective_date <= DATE '{DAY}'",
    ["riskevents"],
)
def _(t):
    return asof.published_as_of(t.risk_events, DAY)


def _summary(name: str, body: str) -> str:
    return f"SELECT '{name}' AS table_name, count(*) AS row_count, count(DISTINCT entity) AS entity_count FROM ({body})"


_V2 = f"publish_time <= DATE '{DAY}' AND effective_date <= DATE '{DAY}'"


@query(
    "d10_snapshot_summary",
    " UNION ALL ".join(
        [
            _summary("daily_prices", f"SELECT * FROM panel WHERE trade_date <= DATE '{DAY}'"),
            _summary("valuation_daily", f"SELECT * FROM panel WHERE trade_date <= DATE '{DAY}'"),
            _summary("universe_members", interval_sql("members", DAY, "entity")),
            _summary("securities", f"SELECT * FROM ({SECURITIES_SQL}) WHERE NOT is_delisted_as_of"),
            _summary("st_status", interval_sql("ststatus", DAY, "entity")),
            _summary("industry_classifications", interval_sql("industries", DAY, "entity")),
            _summary("fundamental_reports", f"SELECT * FROM fundamentals WHERE {_V2}"),
            _summary("announcements", f"SELECT * FROM announcements WHERE {_V2}"),
            _summary("risk_events", f"SELECT * FROM riskevents WHERE {_V2}"),
        ]
    ),
    ["panel", "members", "securities", "ststatus", "industries", "fundamentals", "announcements", "riskevents"],
)
def _(t):
    return asof.snapshot_summary(asof.snapshot(t, DAY))


@query(
    "d11_members_on_all_dates",
    interval_dates_sql("members", "t.entity, t.index_code", "cal"),
    ["members", "cal"],
)
def _(t):
    return asof.intervals_on_dates(t.members, open_days(t.calendar)).select(
        "trade_date", "entity", "index_code", "out_date"
    )


@query(
    "d11_member_counts",
    f"""SELECT trade_date, index_code, count(DISTINCT entity) AS member_count
        FROM ({interval_dates_sql("members", "t.entity, t.index_code", "cal")}) GROUP BY trade_date, index_code""",
    ["members", "cal"],
)
def _(t):
    return asof.active_counts(t.members, ["index_code"], "entity", open_days(t.calendar), "member_count")


@query(
    "d11_industry_counts",
    f"""SELECT trade_date, standard, industry_l1, count(DISTINCT entity) AS member_count
        FROM ({interval_dates_sql("industries", "t.entity, t.standard, t.industry_l1", "cal")}) GROUP BY trade_date, standard, industry_l1""",
    ["industries", "cal"],
)
def _(t):
    return asof.active_counts(t.industries, ["standard", "industry_l1"], "entity", open_days(t.calendar), "member_count")


@query(
    "d11_industries_on_all_dates",
    interval_dates_sql("industries", "t.entity, t.industry_l1, t.industry_l2", "cal"),
    ["industries", "cal"],
)
def _(t):
    return asof.intervals_on_dates(t.industries, open_days(t.calendar)).select(
        "trade_date", "entity", "industry_l1", "industry_l2", "out_date"
    )


cte("monthends", "SELECT max(trade_date) AS trade_date FROM cal WHERE is_open GROUP BY date_trunc('month', trade_date)", ["cal"])


@query(
    "d11_fundamentals_on_month_ends",
    """SELECT d.trade_date, f.entity, f.report_period, f.publish_time, f.revenue
       FROM fundamentals f JOIN monthends d ON f.publish_time <= d.trade_date AND f.effective_date <= d.trade_date""",
    ["fundamentals", "monthends"],
    doubles="revenue",
)
def _(t):
    dates = month_ends(t.calendar).select("signal_date")
    return asof.published_on_dates(t.fundamentals, dates).select(
        "trade_date", "entity", "report_period", "publish_time", "revenue"
    )
