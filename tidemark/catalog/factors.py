"""E: factors over all entities and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.asof import interval_dates_sql
from tidemark.catalog.registry import cte, query
from tidemark.functions.calendar import open_days
from tidemark.operators import factors as fx
from tidemark.params import FACTOR_ORDER, FACTOR_PARAMS

# The weekly panel has amounts around 100,000; the default threshold is meant for daily markets.
PARAMS = {**FACTOR_PARAMS, "min_avg_amount": 50_000.0}

cte(
    "px",
    """
    SELECT *, adj / nullif(lag(adj) OVER (PARTITION BY entity ORDER BY trade_date), 0) - 1 AS ret
    FROM (SELECT *, close * coalesce(adj_factor, 1.0) AS adj,
                 row_number() OVER (PARTITION BY entity ORDER BY trade_date) AS rn FROM panel)
    """,
    ["panel"],
)
_W = "OVER (PARTITION BY entity ORDER BY trade_date ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
_W20, _W60 = _W.format(n=19), _W.format(n=59)
cte(
    "pf",
    f"""
    SELECT entity, trade_date,
           adj / nullif(lag(adj, 20) OVER (PARTITION BY entity ORDER BY trade_date), 0) - 1 AS return_20d,
           adj / nullif(lag(adj, 60) OVER (PARTITION BY entity ORDER BY trade_date), 0) - 1 AS return_60d,
           CASE WHEN count(adj) {_W60} = 60 THEN CASE WHEN adj > avg(adj) {_W60} THEN 1.0 ELSE 0.0 END END AS above_ma60,
           CASE WHEN count(ret) {_W20} = 20 THEN stddev_pop(ret) {_W20} END AS volatility_20d,
           CASE WHEN count(amount) {_W20} = 20 AND avg(amount) {_W20} > 0
                THEN stddev_pop(amount) {_W20} / avg(amount) {_W20} END AS amount_cv_20d,
           CASE WHEN count(amount) {_W20} = 20
                THEN CASE WHEN avg(amount) {_W20} < 50000 THEN 1.0 ELSE 0.0 END END AS low_liquidity,
           CASE WHEN count(CASE WHEN adj > 0 THEN 1 END) {_W60} = 60 THEN list(adj) {_W60} END AS last60
    FROM px
    """,
    ["px"],
)
cte(
    "mdd",
    """
    SELECT entity, trade_date, list_max(list_transform(last60, lambda x, i: 1 - x / list_max(last60[1:i]))) AS max_drawdown_60d
    FROM pf WHERE last60 IS NOT NULL
    """,
    ["pf"],
)
for _name, _col in (("pepct", "pe_ttm"), ("pbpct", "pb")):
    cte(
        _name,
        f"""
        SELECT a.entity, a.trade_date,
               (sum(CASE WHEN b.v < a.v THEN 1.0 WHEN b.v = a.v THEN 0.5 ELSE 0.0 END) - 0.5) / (count(*) - 1) AS {_name}
        FROM (SELECT entity, trade_date, {_col} AS v, row_number() OVER (PARTITION BY entity ORDER BY trade_date) AS rn
              FROM panel WHERE {_col} > 0) a
        JOIN (SELECT entity, {_col} AS v, row_number() OVER (PARTITION BY entity ORDER BY trade_date) AS rn
              FROM panel WHERE {_col} > 0) b
          ON a.entity = b.entity AND b.rn BETWEEN a.rn - 251 AND a.rn
        GROUP BY 1, 2 HAVING count(*) >= 20
        """,
        ["panel"],
    )
cte("ind_on", interval_dates_sql("industries", "t.entity, t.industry_l1, t.industry_l2, t.in_date", "cal"), ["industries", "cal"])
cte("mem_on", interval_dates_sql("members", "t.entity, t.index_code, t.universe_kind", "cal"), ["members", "cal"])
cte("st_on", interval_dates_sql("ststatus", "t.entity", "cal"), ["ststatus", "cal"])
cte(
    "universe_all",
    "SELECT DISTINCT entity, trade_date FROM mem_on WHERE index_code = 'X'",
    ["mem_on"],
)
cte(
    "indpct",
    """
    SELECT entity, trade_date, (rk + (ties - 1) / 2.0 - 1) / (n - 1) AS industry_pe_ttm_percentile
    FROM (SELECT p.entity, p.trade_date,
                 rank() OVER (PARTITION BY p.trade_date, i.industry_l1 ORDER BY p.pe_ttm) AS rk,
                 count(*) OVER (PARTITION BY p.trade_date, i.industry_l1, p.pe_ttm) AS ties,
                 count(*) OVER (PARTITION BY p.trade_date, i.industry_l1) AS n
          FROM panel p
          JOIN universe_all u ON u.entity = p.entity AND u.trade_date = p.trade_date
          JOIN ind_on i ON i.entity = p.entity AND i.trade_date = p.trade_date
          WHERE p.pe_ttm > 0
          )
    WHERE n >= 2
    """,
    ["panel", "universe_all", "ind_on"],
)
cte(
    "fin",
    """
    SELECT c.entity, c.trade_date,
           CASE WHEN p.revenue > 0 THEN c.revenue / p.revenue - 1 END AS revenue_yoy,
           CASE WHEN p.net_profit > 0 THEN c.net_profit / p.net_profit - 1 END AS profit_yoy,
           CASE WHEN c.net_profit > 0 THEN c.operating_cashflow / c.net_profit END AS operating_cashflow_to_profit
    FROM (SELECT * FROM fin_seen QUALIFY report_period = max(report_period) OVER (PARTITION BY entity, trade_date)) c
    LEFT JOIN fin_seen p ON p.entity = c.entity AND p.trade_date = c.trade_date
         AND p.report_period = CAST(c.report_period + 1 - INTERVAL 1 YEAR AS DATE) - 1
    """,
    ["fin_seen"],
)
cte(
    "fin_seen",
    """
    SELECT d.trade_date, f.* FROM fundamentals f
    JOIN cal d ON f.publish_time <= d.trade_date AND f.effective_date <= d.trade_date
    QUALIFY row_number() OVER (PARTITION BY d.trade_date, f.entity, f.report_period ORDER BY f.publish_time DESC) = 1
    """,
    ["fundamentals", "cal"],
)
cte(
    "flags",
    """
    SELECT u.entity, u.trade_date, CASE WHEN s.entity IS NOT NULL THEN 1.0 ELSE 0.0 END AS is_st,
           CASE WHEN p.entity IS NULL THEN 1.0 WHEN p.is_suspended THEN 1.0 ELSE 0.0 END AS is_suspended,
           CASE WHEN x.delist_date <= u.trade_date AND coalesce(x.delist_effective, x.delist_date) <= u.trade_date
                THEN 1.0 ELSE 0.0 END AS is_delisted
    FROM universe_all u
    LEFT JOIN (SELECT DISTINCT entity, trade_date FROM st_on) s ON s.entity = u.entity AND s.trade_date = u.trade_date
    LEFT JOIN panel p ON p.entity = u.entity AND p.trade_date = u.trade_date
    LEFT JOIN securities x ON x.entity = u.entity
    """,
    ["universe_all", "st_on", "panel", "securities"],
)
_SOURCES = {
    "return_20d": "pf", "return_60d": "pf", "above_ma60": "pf", "volatility_20d": "pf", "amount_cv_20d": "pf",
    "low_liquidity": "pf", "max_drawdown_60d": "mdd", "pe_ttm_percentile": "pepct", "pb_percentile": "pbpct",
    "industry_pe_ttm_percentile": "indpct", "revenue_yoy": "fin", "profit_yoy": "fin",
    "operating_cashflow_to_profit": "fin", "is_st": "flags", "is_suspended": "flags", "is_delisted": "flags",
}
_EXPR = {"pe_ttm_percentile": "pepct", "pb_percentile": "pbpct"}


def factor_sql(name: str) -> str:
    """Long rows of one factor inside the universe."""
    expr = _EXPR.get(name, name)
    return f"""
    SELECT f.entity, f.trade_date, '{name}' AS factor_name, CAST(f.{expr} AS DOUBLE) AS factor_value, f.trade_date AS as_of_date
    FROM {_SOURCES[name]} f JOIN universe_all u ON u.entity = f.entity AND u.trade_date = f.trade_date
    WHERE f.{expr} IS NOT NULL
    """


for _f in FACTOR_ORDER:
    cte(f"f_{_f}", factor_sql(_f), [_SOURCES[_f], "universe_all"])
cte("fv", " UNION ALL ".join(f"SELECT * FROM f_{n}" for n in FACTOR_ORDER), [f"f_{n}" for n in FACTOR_ORDER])


def factor_rows(t, names, dates=None):
    return fx.all_factors(t, dates if dates is not None else open_days(t.calendar), names, params=PARAMS)


@query(
    "e0_calculation_universe",
    """SELECT u.entity, u.trade_date FROM universe_all u LEFT JOIN securities x ON x.entity = u.entity
       WHERE NOT coalesce(x.delist_date <= u.trade_date AND coalesce(x.delist_effective, x.delist_date) <= u.trade_date, FALSE)""",
    ["universe_all", "securities"],
)
def _(t):
    return fx.calculation_universe(t.members, t.securities, open_days(t.calendar), "X")


@query(
    "e0_listed_universe",
    """SELECT x.entity, d.trade_date FROM securities x JOIN cal d ON x.list_date <= d.trade_date
       WHERE NOT coalesce(x.delist_date <= d.trade_date AND coalesce(x.delist_effective, x.delist_date) <= d.trade_date, FALSE)""",
    ["securities", "cal"],
)
def _(t):
    return fx.listed_universe(t.securities, open_days(t.calendar))


_IDS = {
    "return_20d": "e1", "return_60d": "e2", "above_ma60": "e3", "volatility_20d": "e4", "max_drawdown_60d": "e5",
    "amount_cv_20d": "e6", "low_liquidity": "e7", "is_st": "e8", "is_suspended": "e9", "is_delisted": "e10",
    "pe_ttm_percentile": "e11", "pb_percentile": "e12", "industry_pe_ttm_percentile": "e13", "revenue_yoy": "e14",
    "profit_yoy": "e15", "operating_cashflow_to_profit": "e16",
}


def _register(name: str) -> None:
    @query(f"{_IDS[name]}_{name}", f"SELECT * FROM f_{name}", [f"f_{name}"], doubles="factor_value")
    def _(t):
        return factor_rows(t, [name])


for _f in FACTOR_ORDER:
    _register(_f)


@query(
    "e17_factor_store",
    "SELECT * FROM fv",
    ["fv"],
    doubles="factor_value",
)
def _(t):
    return factor_rows(t, FACTOR_ORDER)


_RANGE = ("1998-01-01", "1999-12-31")


@query(
    "e18_open_dates_in_range",
    f"SELECT trade_date FROM calgap WHERE is_open AND trade_date BETWEEN DATE '{_RANGE[0]}' AND DATE '{_RANGE[1]}'",
    ["calgap"],
)
def _(t):
    return open_days(t.calendar_gaps, *_RANGE)


@query(
    "e19_factor_range_run",
    f"""SELECT factor_name, trade_date, count(*) AS n, sum(factor_value) AS total FROM fv
        WHERE trade_date BETWEEN DATE '{_RANGE[0]}' AND DATE '{_RANGE[1]}' GROUP BY 1, 2""",
    ["fv"],
    doubles="total",
)
def _(t):
    rows = fx.range_factors(t, t.history, *_RANGE, FACTOR_ORDER, params=PARAMS)
    return rows.groupBy("factor_name", "trade_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("factor_value").alias("total")
    )


_DAY = "1998-06-15"


@query(
    "e19_one_day_run",
    f"SELECT * FROM fv WHERE trade_date = DATE '{_DAY}'",
    ["fv"],
    doubles="factor_value",
)
def _(t):
    return fx.range_factors(t, t.history, _DAY, _DAY, FACTOR_ORDER, params=PARAMS)
