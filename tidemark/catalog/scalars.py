"""B: projections and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import selection as sel
from tidemark.catalog.factors import factor_rows
from tidemark.catalog.registry import cte, query
from tidemark.functions import calendar as cal
from tidemark.functions import columns as col
from tidemark.operators import events as ev
from tidemark.operators import factors as fx
from tidemark.operators import portfolio as pf
from tidemark.operators import scoring as sc
from tidemark.operators.validation import direction_sign
from tidemark.catalog.validation import SIGN

_SIX = "lpad(CAST(o_orderkey * 7919 % 1000000 AS STRING), 6, '0')"
RAW_CODE = (
    f"CASE o_orderkey % 8 WHEN 0 THEN concat({_SIX}, '.SH') WHEN 1 THEN concat('sz', {_SIX}) WHEN 2 THEN {_SIX} "
    f"WHEN 3 THEN concat({_SIX}, '_bj') WHEN 4 THEN concat(' ', {_SIX}, 'sh ') WHEN 5 THEN substring({_SIX}, 2) "
    f"WHEN 6 THEN '' ELSE concat({_SIX}, '.HK') END"
)
RAW_BOOL = (
    "element_at(array('true', ' YES ', '0', 'n', '是', '停牌', 'maybe', '', '1', 'False'), CAST(o_orderkey % 10 AS INT) + 1)"
)
cte(
    "codes",
    """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN six || '.SH' WHEN 1 THEN 'sz' || six WHEN 2 THEN six WHEN 3 THEN six || '_bj'
              WHEN 4 THEN ' ' || six || 'sh ' WHEN 5 THEN substr(six, 2) WHEN 6 THEN '' ELSE six || '.HK' END AS raw
       FROM (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS six FROM orders)""",
)
_CODE_SQL = """CASE WHEN regexp_full_match(s, '[0-9]{6}[.](SH|SZ|BJ)') THEN s
    WHEN regexp_full_match(s, '[0-9]{6}(SH|SZ|BJ)') THEN substr(s, 1, 6) || '.' || substr(s, 7)
    WHEN regexp_full_match(s, '(SH|SZ|BJ)[0-9]{6}') THEN substr(s, 3) || '.' || substr(s, 1, 2)
    WHEN regexp_full_match(s, '[0-9]{6}') THEN CASE WHEN s[1] = '6' THEN s || '.SH' WHEN s[1] IN ('0', '3') THEN s || '.SZ'
         WHEN s[1] IN ('4', '8', '9') THEN s || '.BJ' END END"""
cte("ncodes", f"SELECT o_orderkey, raw, {_CODE_SQL} AS code FROM (SELECT *, replace(upper(trim(raw)), '_', '.') AS s FROM codes)", ["codes"])


@query("b1_stock_code", "SELECT o_orderkey, code FROM ncodes", ["ncodes"])
def _(t):
    return t.raw("orders").selectExpr("o_orderkey", f"{RAW_CODE} AS raw").selectExpr(
        "o_orderkey", f"{col.stock_code('raw')} AS code"
    )


@query(
    "b2_index_code",
    """SELECT o_orderkey, CASE WHEN trim(raw) = '' THEN NULL WHEN regexp_full_match(s, '[0-9]{6}') THEN s || '.SH'
              WHEN regexp_full_match(s, '[0-9]{6}[.](SH|SZ|BJ)') THEN s ELSE trim(raw) END AS code
       FROM (SELECT *, replace(upper(trim(raw)), '_', '.') AS s FROM codes)""",
    ["codes"],
)
def _(t):
    return t.raw("orders").selectExpr("o_orderkey", f"{RAW_CODE} AS raw").selectExpr(
        "o_orderkey", f"{col.index_code('raw')} AS code"
    )


@query(
    "b3_exchange",
    """SELECT o_orderkey, CASE WHEN ends_with(code, '.SH') THEN 'SHSE' WHEN ends_with(code, '.SZ') THEN 'SZSE'
              WHEN ends_with(code, '.BJ') THEN 'BSE' END AS exchange FROM ncodes""",
    ["ncodes"],
)
def _(t):
    codes = t.raw("orders").selectExpr("o_orderkey", f"{RAW_CODE} AS raw").selectExpr(
        "o_orderkey", f"{col.stock_code('raw')} AS code"
    )
    return codes.selectExpr("o_orderkey", f"{col.exchange('code')} AS exchange")


@query(
    "b4_boolean_words",
    "SELECT o_orderkey, [TRUE, TRUE, FALSE, FALSE, TRUE, FALSE, NULL, NULL, TRUE, FALSE][o_orderkey % 10 + 1] AS flag FROM orders",
)
def _(t):
    return t.raw("orders").selectExpr("o_orderkey", f"{RAW_BOOL} AS w").selectExpr("o_orderkey", f"{col.to_bool('w')} AS flag")


@query(
    "b5_next_open_day",
    """SELECT o_orderkey, (SELECT min(trade_date) FROM calgap c WHERE c.is_open AND c.trade_date > CAST(o_orderdate AS DATE)) AS next_open
       FROM orders""",
    ["calgap"],
)
def _(t):
    days = t.raw("orders").selectExpr("o_orderkey", "to_date(o_orderdate) AS d")
    return cal.next_open(days, "d", t.calendar_gaps, "next_open").select("o_orderkey", "next_open")


@query(
    "b6_effective_date",
    "SELECT announcement_id, publish_time, effective_date FROM announcements",
    ["announcements"],
)
def _(t):
    return t.announcements.select("announcement_id", "publish_time", "effective_date")


@query(
    "b6_unplaced_facts",
    """SELECT 'orders' AS dataset, 'no_open_day_after_publication' AS issue, count(*) AS row_count, min(d) AS first_publish, max(d) AS last_publish
       FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders) WHERE d >= (SELECT max(trade_date) FROM cal WHERE trade_date < DATE '1998-01-01')""",
    ["cal"],
)
def _(t):
    """Facts published on or after the last open day of a calendar that ends in 1997."""
    known = t.calendar.filter("trade_date < DATE'1998-01-01'")
    rows = cal.next_open(t.raw("orders").selectExpr("to_date(o_orderdate) AS publish_time"), "publish_time", known, "effective_date")
    return cal.unplaced(rows, "orders")


cte(
    "gapnext",
    """SELECT day, (SELECT min(trade_date) FROM calgap WHERE is_open AND trade_date > day) AS next_open
       FROM (SELECT CAST(unnest(generate_series(DATE '1994-01-01', DATE '2003-12-31', INTERVAL 1 DAY)) AS DATE) AS day)""",
    ["calgap"],
)


@query(
    "b7_fill_effective_dates",
    """SELECT o_orderkey, CASE WHEN eff IS NOT NULL THEN eff WHEN pub IS NOT NULL THEN g.next_open ELSE d END AS in_effective
       FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + 9 END AS eff,
                    CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) - 4 END AS pub FROM orders) o
       LEFT JOIN gapnext g ON g.day = o.pub""",
    ["gapnext"],
)
def _(t):
    rows = t.raw("orders").selectExpr(
        "o_orderkey",
        "to_date(o_orderdate) AS in_date",
        "CASE WHEN o_orderkey % 3 = 0 THEN date_add(to_date(o_orderdate), 9) END AS in_effective",
        "CASE WHEN o_orderkey % 2 = 0 THEN date_sub(to_date(o_orderdate), 4) END AS in_publish",
    )
    return cal.fill_effective(rows, "in_effective", "in_publish", "in_date", t.calendar_gaps).select(
        "o_orderkey", "in_effective"
    )


@query(
    "b8_calendar_neighbors",
    """SELECT c.trade_date, c.is_open, coalesce(CASE WHEN (c.trade_date - DATE '1995-01-02') % 35 = 0 THEN c.trade_date - 1 END, n.p) AS prev_trade_date, n.q AS next_trade_date
       FROM calgap c LEFT JOIN (SELECT trade_date, lag(trade_date) OVER (ORDER BY trade_date) AS p, lead(trade_date) OVER (ORDER BY trade_date) AS q
                                FROM calgap WHERE is_open) n ON n.trade_date = c.trade_date""",
    ["calgap"],
)
def _(t):
    given = t.calendar_gaps.selectExpr(
        "trade_date",
        "is_open",
        "CASE WHEN datediff(trade_date, DATE'1995-01-02') % 35 = 0 THEN date_sub(trade_date, 1) END AS prev_trade_date",
        "CAST(NULL AS DATE) AS next_trade_date",
    )
    return cal.fill_neighbors(given)


@query(
    "b9_adjusted_close",
    "SELECT entity, trade_date, close * coalesce(adj_factor, 1.0) AS adjusted_close FROM panel",
    ["panel"],
    doubles="adjusted_close",
)
def _(t):
    return t.prices.selectExpr("entity", "trade_date", f"{fx.ADJUSTED_CLOSE} AS adjusted_close")


@query(
    "b10_strict_adjusted_close",
    """SELECT entity, trade_date, CASE WHEN c > 0 THEN c * coalesce(adj_factor, 1.0) END AS adjusted_close,
              coalesce(c > 0, FALSE) AND adj_factor IS NULL AS used_fallback
       FROM (SELECT *, CASE WHEN entity % 8 = 0 THEN -close ELSE close END AS c FROM panel)""",
    ["panel"],
    doubles="adjusted_close",
)
def _(t):
    rows = t.prices.selectExpr("entity", "trade_date", "CASE WHEN entity % 8 = 0 THEN -close ELSE close END AS close", "adj_factor")
    return rows.selectExpr(
        "entity", "trade_date", f"{fx.STRICT_ADJUSTED_CLOSE} AS adjusted_close",
        "coalesce(close > 0, false) AND adj_factor IS NULL AS used_fallback",
    )


@query(
    "b11_month_bucket",
    "SELECT entity, CAST(date_trunc('month', trade_date) AS DATE) AS month, count(*) AS n FROM panel GROUP BY 1, 2",
    ["panel"],
)
def _(t):
    return t.prices.groupBy("entity", F.expr("trunc(trade_date, 'month') AS month")).agg(F.expr("count(*) AS n"))


@query(
    "b12_same_period_last_year",
    """SELECT DISTINCT entity, report_period, CAST(report_period + 1 - INTERVAL 1 YEAR AS DATE) - 1 AS prior_period FROM fundamentals""",
    ["fundamentals"],
)
def _(t):
    return t.fundamentals.selectExpr("entity", "report_period", "add_months(report_period, -12) AS prior_period").distinct()


@query(
    "b13_year_over_year",
    """SELECT c.entity, c.report_period, c.publish_time, CASE WHEN p.net_profit > 0 THEN c.net_profit / p.net_profit - 1 END AS growth
       FROM fundamentals c JOIN fundamentals p ON p.entity = c.entity
        AND p.report_period = CAST(c.report_period + 1 - INTERVAL 1 YEAR AS DATE) - 1
        AND p.publish_time = p.report_period + CAST(p.entity % 10 + 20 AS INTEGER)""",
    ["fundamentals"],
    doubles="growth",
)
def _(t):
    first = t.fundamentals.filter("publish_time = date_add(report_period, CAST(entity % 10 + 20 AS INT))")
    prior = first.selectExpr("entity", "add_months(report_period, 12) AS report_period", "net_profit AS base")
    # add_months keeps quarter ends on quarter ends only backwards, so pin the month end.
    prior = prior.selectExpr("entity", "last_day(report_period) AS report_period", "base")
    return t.fundamentals.join(prior, ["entity", "report_period"]).selectExpr(
        "entity", "report_period", "publish_time", f"{fx.year_over_year('net_profit', 'base')} AS growth"
    )


@query(
    "b14_cash_to_profit",
    """SELECT entity, report_period, publish_time, CASE WHEN net_profit > 0 THEN operating_cashflow / net_profit END AS ratio FROM fundamentals""",
    ["fundamentals"],
    doubles="ratio",
)
def _(t):
    return t.fundamentals.selectExpr(
        "entity", "report_period", "publish_time", f"{fx.cash_to_profit('operating_cashflow', 'net_profit')} AS ratio"
    )


_B15 = ["return_20d", "volatility_20d", "is_st"]


@query(
    "b15_oriented_value",
    f"SELECT entity, trade_date, factor_name, factor_value * {SIGN} AS oriented FROM ({' UNION ALL '.join(f'SELECT * FROM f_{n}' for n in _B15)})",
    [f"f_{n}" for n in _B15],
    doubles="oriented",
)
def _(t):
    return factor_rows(t, _B15).selectExpr(
        "entity", "trade_date", "factor_name", f"factor_value * {direction_sign()} AS oriented"
    )


@query(
    "b16_clamp",
    """SELECT entity, trade_date, CASE WHEN float_mv IS NOT NULL THEN least(greatest(float_mv, 20000), 60000) END AS bounded FROM panel""",
    ["panel"],
    doubles="bounded",
)
def _(t):
    return t.valuations.selectExpr("entity", "trade_date", f"{sc.clamp('float_mv', 20000, 60000)} AS bounded")


_SIDE = "CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END"


@query(
    "b17_trade_costs",
    f"""SELECT side, count(*) AS n, sum(greatest(x * 0.00025, 5)) AS commission, sum(CASE WHEN side = 'sell' THEN x * 0.001 ELSE 0 END) AS stamp_tax
        FROM (SELECT {_SIDE} AS side, l_extendedprice AS x FROM lineitem) GROUP BY 1""",
    doubles="commission stamp_tax",
)
def _(t):
    rows = t.raw("lineitem").selectExpr(f"{_SIDE} AS side", "l_extendedprice AS x").selectExpr(
        "side", f"{pf.trade_costs('side', 'x')} AS c"
    )
    return rows.groupBy("side").agg(
        F.expr("count(*) AS n"), F.expr("sum(c.commission) AS commission"), F.expr("sum(c.stamp_tax) AS stamp_tax")
    )


@query(
    "b18_board_lots",
    """SELECT bought, sold, count(*) AS n FROM (
         SELECT floor(req / 100) * 100 AS bought,
                CASE WHEN req >= held - 1e-9 THEN held
                     WHEN held - floor(held / 100) * 100 > 1e-9 AND floor(req / 100) * 100 + held - floor(held / 100) * 100 <= req + 1e-9
                       THEN floor(req / 100) * 100 + held - floor(held / 100) * 100
                     WHEN floor(req / 100) * 100 <= 1e-12 AND held - floor(held / 100) * 100 <= req + 1e-9 THEN held - floor(held / 100) * 100
                     ELSE floor(req / 100) * 100 END AS sold
         FROM (SELECT l_quantity * 13 AS req, CAST(l_partkey % 700 AS DOUBLE) AS held FROM lineitem)) GROUP BY 1, 2""",
    doubles="bought sold",
)
def _(t):
    rows = t.raw("lineitem").selectExpr("l_quantity * 13 AS req", "CAST(l_partkey % 700 AS DOUBLE) AS held").selectExpr(
        f"CAST({pf.round_lot('req', 100)} AS DOUBLE) AS bought", f"{pf.round_sell('req', 'held', 100)} AS sold"
    )
    return rows.groupBy("bought", "sold").agg(F.expr("count(*) AS n"))


# The documents are already in NFKC form, so the SQL side only collapses white space.
cte("normdoc", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS normalized FROM documents")


@query("b19_normalized_text", "SELECT * FROM normdoc", ["normdoc"])
def _(t):
    return col.normalize_text(t.raw("documents").select("doc_id", "text"), "text", "normalized").select("doc_id", "normalized")


@query("b20_text_hash", "SELECT doc_id, sha256(normalized) AS text_hash FROM normdoc", ["normdoc"])
def _(t):
    docs = col.normalize_text(t.raw("documents").select("doc_id", "text"), "text", "normalized")
    return docs.selectExpr("doc_id", f"{col.text_hash('normalized')} AS text_hash")


@query(
    "b21_stable_ids",
    """SELECT announcement_id, sha1('run|' || coalesce(source_tag, '') || '|' || CAST(announcement_id AS VARCHAR)) AS parse_id,
              sha1(coalesce(source_tag, '') || '|' || CAST(entity AS VARCHAR) || '|' || CAST(publish_time AS VARCHAR) || '|' || lower(title) || '||') AS stable_id
       FROM announcements""",
    ["announcements"],
)
def _(t):
    return t.announcements.selectExpr(
        "announcement_id",
        f"{col.stable_id(repr('run'), 'source_tag', 'announcement_id')} AS parse_id",
        f"{col.stable_id('source_tag', 'entity', 'publish_time', 'lower(title)', 'NULL', 'NULL')} AS stable_id",
    )


@query("b24_risk_tips", "SELECT as_of_date, entity, risk_tips FROM cands", ["cands"])
def _(t):
    return sel.candidates(t).select("as_of_date", "entity", "risk_tips")


@query("b25_selection_reason", "SELECT as_of_date, entity, selection_reason FROM cands", ["cands"])
def _(t):
    return sel.candidates(t).select("as_of_date", "entity", "selection_reason")


@query(
    "b26_json_fields",
    "SELECT run_id, run_mode, source_run_id FROM runs",
    ["runs"],
)
def _(t):
    return t.runs.selectExpr(
        "run_id",
        "get_json_object(params, '$.run_mode') AS run_mode",
        "nullif(trim(get_json_object(params, '$.source_run_id')), '') AS source_run_id",
    )


@query(
    "b26_event_props",
    "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
)
def _(t):
    return t.raw("events").selectExpr("CAST(get_json_object(props, '$.k') AS BIGINT) AS k").groupBy("k").agg(
        F.expr("count(*) AS n")
    )


@query(
    "b27_json_list_filled",
    """SELECT announcement_id, announcement_id % 17 <> 0 AND announcement_id % 3 = 0 AS has_risks,
              announcement_id % 17 <> 0 AND announcement_id % 8 = 0 AS has_catalysts FROM announcements""",
    ["announcements"],
)
def _(t):
    return t.parsed_results.selectExpr(
        "announcement_id",
        f"{ev.json_list_filled('parsed_json', 'risks')} AS has_risks",
        f"{ev.json_list_filled('parsed_json', 'catalysts')} AS has_catalysts",
    )
