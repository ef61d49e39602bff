"""C: constraints and data checks.  L: profiles and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.factors import factor_rows
from tidemark.catalog.asof import interval_sql
from tidemark.catalog.universe import names_sql
from tidemark.catalog.registry import cte, query
from tidemark.functions.calendar import is_open_on, open_days
from tidemark.operators import asof
from tidemark.operators import quality as qa
from tidemark.operators import universe as un
from tidemark.params import FACTOR_ORDER, HARD_FILTERS, QUALITY_GATE

DAY = "1999-06-07"

# A panel with faults on purpose.
_DIRTY = [
    ("entity", "entity"), ("trade_date", "trade_date"), ("open", "CASE WHEN entity % 6 = 0 THEN NULL ELSE open END"),
    ("high", "CASE WHEN entity % 10 = 0 THEN low / 2 ELSE high END"), ("low", "low"), ("close", "close"),
    ("volume", "CASE WHEN entity % 11 = 0 THEN -volume ELSE volume END"),
    ("amount", "CASE WHEN entity % 12 = 0 THEN -amount ELSE amount END"), ("adj_factor", "adj_factor"),
    ("is_suspended", "CASE WHEN entity % 5 = 0 THEN NULL ELSE is_suspended END"),
    ("limit_up", "CASE WHEN entity % 8 = 0 THEN NULL ELSE limit_up END"), ("limit_down", "limit_down"),
]
_DIRTY_SELECT = [f"{rule} AS {name}" for name, rule in _DIRTY]
cte("dirty", f"SELECT {', '.join(_DIRTY_SELECT)} FROM panel", ["panel"])


def dirty(t):
    return t.prices.selectExpr(*_DIRTY_SELECT)


REQUIRED = ["entity", "trade_date", "open", "high", "low", "close", "volume", "amount"]


def _issue_sql(source: str, rules, dataset: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{dataset}' AS dataset, '{s}' AS severity, '{c}' AS code, '{m}' AS message, count(*) AS row_count FROM {source} WHERE {r} HAVING count(*) > 0"
        for s, c, m, r in rules
    )


_REQ_RULES = [
    ("error", "missing_required_values", f"daily_prices.{c} has missing required values.", f"{c} IS NULL") for c in REQUIRED
]
_SQL_WARN = [(s, c, m, r.split(" IS NULL")[0].lstrip("(") + " IS NULL") for s, c, m, r in qa.PRICE_WARNINGS]


@query("c1_required_values", _issue_sql("dirty", _REQ_RULES, "daily_prices"), ["dirty"])
def _(t):
    return qa.required_values(dirty(t), "daily_prices", REQUIRED)


@query(
    "c1_missing_columns",
    " UNION ALL ".join(
        f"SELECT 'daily_prices' AS dataset, 'error' AS severity, 'missing_required_column' AS code, "
        f"'daily_prices is missing column {c}.' AS message, count(*) AS row_count FROM panel HAVING count(*) > 0"
        for c in ("volume", "source")
    ),
    ["panel"],
)
def _(t):
    return qa.missing_columns(t.prices.drop("volume"), "daily_prices", ["entity", "trade_date", "close", "volume", "source"])


@query(
    "c2_duplicate_key_rows",
    """SELECT coalesce(sum(n), 0) AS duplicate_key_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""",
    longs="duplicate_key_rows",
)
def _(t):
    return qa.duplicate_key_rows(t.raw("lineitem"), ["l_orderkey", "l_linenumber"])


@query("c3_price_errors", _issue_sql("dirty", qa.PRICE_ERRORS, "daily_prices"), ["dirty"])
def _(t):
    return qa.counted_issues(dirty(t), "daily_prices", qa.PRICE_ERRORS)


@query("c4_price_warnings", _issue_sql("dirty", _SQL_WARN, "daily_prices"), ["dirty"])
def _(t):
    return qa.counted_issues(dirty(t), "daily_prices", qa.PRICE_WARNINGS)


@query("c5_valuation_warnings", _issue_sql("panel", qa.VALUATION_WARNINGS, "valuation_daily"), ["panel"])
def _(t):
    return qa.counted_issues(t.valuations, "valuation_daily", qa.VALUATION_WARNINGS)


@query(
    "c6_issue_table",
    f"{_issue_sql('dirty', qa.PRICE_ERRORS, 'daily_prices')} UNION ALL {_issue_sql('panel', qa.VALUATION_WARNINGS, 'valuation_daily')}",
    ["dirty", "panel"],
)
def _(t):
    return qa.issue_table(
        [
            qa.counted_issues(dirty(t), "daily_prices", qa.PRICE_ERRORS),
            qa.counted_issues(t.valuations, "valuation_daily", qa.VALUATION_WARNINGS),
        ]
    )


@query(
    "c6_no_issue_placeholder",
    """SELECT 'all' AS dataset, 'info' AS severity, 'no_validation_issues' AS code, 'No validation issues were emitted.' AS message,
              CAST(NULL AS BIGINT) AS row_count FROM panel WHERE high < low HAVING count(*) = 0""",
    ["panel"],
)
def _(t):
    return qa.issue_table([qa.counted_issues(t.prices, "daily_prices", qa.PRICE_ERRORS[:1])])


# Interval rows with faults: one per order, keyed by status and customer.
_IV = [
    ("id", "o_orderkey", "o_orderkey"),
    ("source_tag", "o_orderstatus", "o_orderstatus"),
    ("entity", "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_custkey END", None),
    ("in_date", "d", "d"),
    ("in_publish", "CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN d + 5 ELSE d - 3 END", None),
    ("in_effective", "d + 1", None),
    ("out_date", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE d + CAST(o_orderkey % 300 AS INT) END", None),
    ("out_publish", "CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 29 = 0 THEN NULL ELSE d + CAST(o_orderkey % 300 AS INT) - 2 END", None),
    ("out_effective", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE d + CAST(o_orderkey % 280 AS INT) END", None),
    ("universe_kind", "CASE WHEN o_orderkey % 2 = 0 THEN 'historical_pit' ELSE 'current_snapshot' END", None),
]
cte("iv", f"SELECT {', '.join(f'{e} AS {n}' for n, e, _ in _IV)} FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)")


def intervals(t):
    def spark_sql(e: str) -> str:
        return e

    base = t.raw("orders").selectExpr("*", "to_date(o_orderdate) AS d")
    return base.selectExpr(*[f"{spark_sql(e)} AS {n}" for n, e, _ in _IV])


@query(
    "c7_interval_sanity",
    """SELECT * FROM (SELECT *, CASE WHEN source_tag IS NULL OR entity IS NULL OR in_date IS NULL OR in_effective IS NULL THEN 'missing_required'
              WHEN out_effective <= in_effective THEN 'out_effective_not_after_in' WHEN out_date <= in_date THEN 'out_date_not_after_in' END AS issue FROM iv)
       WHERE issue IS NOT NULL""",
    ["iv"],
)
def _(t):
    return qa.interval_issues(intervals(t), ["source_tag", "entity", "in_date", "in_effective"])


@query(
    "c8_interval_overlaps",
    """SELECT * FROM (WITH starts AS (SELECT source_tag, entity, in_effective, count(*) AS copies,
              CASE WHEN count(out_effective) = count(*) THEN max(out_effective) ELSE DATE '9999-12-31' END AS far FROM iv GROUP BY 1, 2, 3),
       reached AS (SELECT s.source_tag, s.entity, s.in_effective, max(p.far) AS far FROM starts s
              JOIN starts p ON p.source_tag IS NOT DISTINCT FROM s.source_tag AND p.entity IS NOT DISTINCT FROM s.entity
                           AND p.in_effective < s.in_effective GROUP BY 1, 2, 3),
       named AS (SELECT r.*, (SELECT max(p.in_effective) FROM starts p WHERE p.source_tag IS NOT DISTINCT FROM r.source_tag
              AND p.entity IS NOT DISTINCT FROM r.entity AND p.in_effective < r.in_effective AND p.far = r.far) AS prev_in FROM reached r)
       SELECT * FROM (SELECT s.source_tag, s.entity, s.in_effective, s.copies, n.prev_in, nullif(n.far, DATE '9999-12-31') AS prev_out,
              CASE WHEN s.copies > 1 THEN 'duplicate_start' WHEN n.far = DATE '9999-12-31' THEN 'open_ended_overlap'
                   WHEN s.in_effective < n.far THEN 'overlap' END AS issue
       FROM starts s LEFT JOIN named n ON n.source_tag IS NOT DISTINCT FROM s.source_tag AND n.entity IS NOT DISTINCT FROM s.entity
            AND n.in_effective IS NOT DISTINCT FROM s.in_effective) WHERE issue IS NOT NULL)""",
    ["iv"],
)
def _(t):
    return qa.interval_overlaps(intervals(t), ["source_tag", "entity"])


@query(
    "c9_point_in_time_rules",
    """SELECT * FROM (SELECT *, CASE WHEN in_publish IS NULL THEN 'missing_in_publish' WHEN in_publish > in_effective THEN 'in_publish_after_effective'
              WHEN (out_date IS NOT NULL OR out_publish IS NOT NULL OR out_effective IS NOT NULL)
                   AND (out_date IS NULL OR out_publish IS NULL OR out_effective IS NULL) THEN 'incomplete_exit'
              WHEN out_publish > out_effective THEN 'out_publish_after_effective' END AS issue
       FROM iv WHERE universe_kind = 'historical_pit') WHERE issue IS NOT NULL""",
    ["iv"],
)
def _(t):
    return qa.pit_issues(intervals(t))


_KEY = "source_run_id, entity, trade_date, as_of_date, factor_name"


@query(
    "c10_duplicate_factor_keys",
    f"""SELECT {_KEY}, count(*) AS row_count FROM (SELECT *, 'run_a' AS source_run_id FROM f_return_60d
        UNION ALL SELECT *, 'run_a' FROM f_return_60d WHERE entity % 10 = 4) GROUP BY {_KEY} HAVING count(*) > 1""",
    ["f_return_60d"],
)
def _(t):
    copies = "explode(CASE WHEN entity % 10 = 4 THEN array(1, 2) ELSE array(1) END) AS c"
    rows = factor_rows(t, ["return_60d"]).selectExpr("*", "'run_a' AS source_run_id", copies)
    return qa.duplicate_keys(rows, _KEY.split(", "))


@query(
    "c11_kind_guard",
    """SELECT coalesce(universe_kind, 'unknown') AS universe_kind,
              coalesce(nullif(trim(source_tag), ''), nullif(trim(source), ''), 'unknown') AS resolved_tag, count(*) AS row_count,
              coalesce(universe_kind, 'unknown') = 'historical_pit'
              AND coalesce(nullif(trim(source_tag), ''), nullif(trim(source), ''), 'unknown') = 'main' AS allowed
       FROM members GROUP BY ALL""",
    ["members"],
)
def _(t):
    return un.kind_guard(t.members, source_tag="main")


@query(
    "c12_open_trading_day",
    f"SELECT count(*) AS calendar_rows, coalesce(bool_or(is_open), FALSE) AS is_open FROM calgap WHERE trade_date = DATE '{DAY}'",
    ["calgap"],
)
def _(t):
    return is_open_on(t.calendar_gaps, DAY)


# ---- L ---------------------------------------------------------------------


def _summary_sql(dataset: str, source: str, keys: str, date: str, coverage: str, named: bool = False, entity: bool = True) -> str:
    names = ", ".join(
        f"(SELECT count(DISTINCT {c}) FROM {source}) AS {c}_count, {names_sql(source, c)} AS {c}_values"
        if named
        else f"0 AS {c}_count, CAST(NULL AS VARCHAR) AS {c}_values"
        for c in ("source", "source_tag")
    )
    return f"""
    SELECT '{dataset}' AS dataset, sum(n) AS row_count, {'count(DISTINCT entity)' if entity else 'NULL'} AS stock_count, min(lo) AS start_date, max(hi) AS end_date,
           coalesce(sum(n) FILTER (WHERE n > 1), 0) AS duplicate_key_rows, {names}, {coverage} AS coverage_rate
    FROM (SELECT {keys}, count(*) AS n, min({date}) AS lo, max({date}) AS hi FROM {source} GROUP BY {keys})"""


_CELLS = "((SELECT count(*) FROM securities) * (SELECT count(*) FROM cal))"


@query(
    "l1_dataset_summary",
    " UNION ALL ".join(
        [
            _summary_sql("daily_prices", "panel", "entity, trade_date", "trade_date", f"sum(n) / {_CELLS}"),
            _summary_sql("valuation_daily", "panel", "entity, trade_date", "trade_date", f"sum(n) / {_CELLS}"),
            _summary_sql("universe_members", "members", "source_tag, index_code, entity, in_date", "in_date", "NULL", named=True),
            _summary_sql("trading_calendar", "cal", "trade_date", "trade_date", "NULL", entity=False),
        ]
    ),
    ["panel", "members", "cal", "securities"],
    doubles="coverage_rate",
    longs="row_count stock_count duplicate_key_rows source_count source_tag_count",
)
def _(t):
    symbols, days = t.securities.select("entity"), open_days(t.calendar)
    parts = [
        qa.dataset_summary(t.prices, "daily_prices", ["entity", "trade_date"], "trade_date", symbols, days),
        qa.dataset_summary(t.valuations, "valuation_daily", ["entity", "trade_date"], "trade_date", symbols, days),
        qa.dataset_summary(t.members, "universe_members", ["source_tag", "index_code", "entity", "in_date"], "in_date"),
        qa.dataset_summary(t.calendar, "trading_calendar", ["trade_date"], "trade_date"),
    ]
    return qa.assemble_gate(parts)


@query(
    "l1_source_names",
    """SELECT 'announcements' AS dataset, 'source' AS column_name, source AS value, count(*) AS row_count FROM announcements
       WHERE source IS NOT NULL GROUP BY source
       UNION ALL SELECT 'announcements', 'source_tag', source_tag, count(*) FROM announcements WHERE source_tag IS NOT NULL GROUP BY source_tag""",
    ["announcements"],
)
def _(t):
    return qa.source_names(t.announcements, "announcements")


_FIELDS = [n for n, _ in _DIRTY] + ["source"]


@query(
    "l2_field_summary",
    " UNION ALL ".join(
        f"SELECT 'daily_prices' AS dataset, '{f}' AS field, count(*) AS row_count, "
        + (f"count(*) FILTER (WHERE {f} IS NULL)" if f != "source" else "count(*)")
        + " AS missing_count, "
        + (f"count(*) FILTER (WHERE {f} IS NULL) / count(*)" if f != "source" else "1")
        + " AS missing_rate FROM dirty"
        for f in _FIELDS
    ),
    ["dirty"],
    doubles="missing_rate",
)
def _(t):
    return qa.field_summary(dirty(t), "daily_prices", _FIELDS)


cte("um", interval_sql("members", DAY, "entity, universe_kind, index_code", "index_code = 'X'"), ["members"])
cte("fvd", " UNION ALL ".join(f"SELECT * FROM f_{n} WHERE trade_date = DATE '{DAY}'" for n in FACTOR_ORDER), [f"f_{n}" for n in FACTOR_ORDER])


def _gate_sql(check: str, status: str, severity: str, observed: str, expected: str, source: str) -> str:
    return f"SELECT '{check}' AS check_name, {status} AS status, {severity} AS severity, {observed} AS observed, '{expected}' AS expected FROM {source}"


_CAL_SQL = _gate_sql(
    "trading_calendar_open", "CASE WHEN count(*) > 0 AND bool_or(is_open) THEN 'PASS' ELSE 'FAIL' END", "'blocking'",
    "'rows=' || count(*) || '; is_open=' || coalesce(bool_or(is_open), FALSE)", "row exists and is_open=true",
    f"cal WHERE trade_date = DATE '{DAY}'",
)
_UNI_SQL = _gate_sql(
    "target_universe", "CASE WHEN count(DISTINCT entity) > 0 THEN 'PASS' ELSE 'FAIL' END", "'blocking'",
    "CAST(count(DISTINCT entity) AS VARCHAR)", "> 0", "um",
)
_KIND_SQL = """SELECT 'universe_kind_profile' AS check_name, CASE WHEN count(*) = count(*) FILTER (WHERE k = 'historical_pit') THEN 'PASS' ELSE 'WARN' END AS status,
       CASE WHEN count(*) = count(*) FILTER (WHERE k = 'historical_pit') THEN 'info' ELSE 'warning' END AS severity,
       string_agg(k || '=' || n, '; ' ORDER BY k) AS observed, 'historical_pit for formal research' AS expected
    FROM (SELECT coalesce(nullif(trim(universe_kind), ''), 'unknown_legacy') AS k, count(*) AS n FROM um GROUP BY 1)"""


def _cov_sql(check: str, covered: str, minimum: float) -> str:
    return f"""SELECT '{check}' AS check_name, CASE WHEN c / n >= {minimum} THEN 'PASS' ELSE 'FAIL' END AS status, 'blocking' AS severity,
        c || '/' || n || ' (' || printf('%.2f', c / n * 100) || '%)' AS observed, '>= {minimum:.2%}' AS expected
        FROM (SELECT count(DISTINCT u.entity) AS n, count(DISTINCT p.entity) AS c FROM um u LEFT JOIN ({covered}) p ON p.entity = u.entity)"""


_PX_SQL = _cov_sql("daily_prices_coverage", f"SELECT entity FROM panel WHERE trade_date = DATE '{DAY}'", 0.8)
_VAL_SQL = _cov_sql("valuation_daily_coverage", f"SELECT entity FROM panel WHERE trade_date = DATE '{DAY}'", 0.8)
_FAC_SQL = """SELECT 'factor_values_source_run' AS check_name, CASE WHEN r > 0 AND s / n >= 0.8 THEN 'PASS' ELSE 'FAIL' END AS status, 'blocking' AS severity,
    'rows=' || r || '; stocks=' || s || '/' || n || '; factors=' || f AS observed, 'rows > 0 and stock coverage >= 80.00%' AS expected
    FROM (SELECT count(*) AS r, count(DISTINCT entity) AS s, count(DISTINCT factor_name) AS f FROM fvd), (SELECT count(DISTINCT entity) AS n FROM um)"""
_HF_SQL = _cov_sql(
    "hard_filter_coverage",
    "SELECT entity FROM fvd WHERE factor_name IN ('is_st', 'is_suspended', 'is_delisted', 'low_liquidity') GROUP BY 1 HAVING count(DISTINCT factor_name) >= 4",
    0.8,
)


def _opt_sql(table: str, source: str) -> str:
    return f"""SELECT '{table}_available' AS check_name, CASE WHEN n > 0 THEN 'PASS' ELSE 'WARN' END AS status,
        CASE WHEN n > 0 THEN 'info' ELSE 'warning' END AS severity, CAST(n AS VARCHAR) AS observed,
        CASE WHEN n > 0 THEN '> 0' ELSE '> 0 or configured downgrade' END AS expected
        FROM (SELECT count(*) AS n FROM {source} WHERE effective_date <= DATE '{DAY}')"""


_OPT_SQL = _opt_sql("announcements", "announcements") + " UNION ALL " + _opt_sql("risk_events", "riskevents")
_ALL_SQL = " UNION ALL ".join([_CAL_SQL, _UNI_SQL, _KIND_SQL, _PX_SQL, _VAL_SQL, _FAC_SQL, _HF_SQL, _OPT_SQL])
_ALL_READS = ["cal", "um", "panel", "fvd", "announcements", "riskevents"]


def members(t):
    return asof.members_as_of(t.members, DAY, "X")


def prices_on_day(t):
    return t.prices.filter(f"trade_date = DATE'{DAY}'")


def day_rows(t, names):
    return factor_rows(t, names, open_days(t.calendar, DAY, DAY))


def optional(t):
    return qa.optional_gate(t.announcements, "announcements", DAY).unionByName(
        qa.optional_gate(t.risk_events, "risk_events", DAY)
    )


@query("l3_calendar_gate", _CAL_SQL, ["cal"])
def _(t):
    return qa.calendar_gate(t.calendar, DAY)


@query("l4_universe_kind_gate", _KIND_SQL, ["um"])
def _(t):
    return qa.kind_gate(un.kind_counts(members(t)))


@query("l5_coverage_gates", f"{_PX_SQL} UNION ALL {_VAL_SQL}", ["um", "panel"])
def _(t):
    px = qa.coverage_gate(prices_on_day(t), members(t), "daily_prices_coverage", QUALITY_GATE["min_price_coverage"])
    val = qa.coverage_gate(
        t.valuations.filter(f"trade_date = DATE'{DAY}'"), members(t), "valuation_daily_coverage", QUALITY_GATE["min_valuation_coverage"]
    )
    return px.unionByName(val)


@query("l6_factor_rows_gate", _FAC_SQL, ["um", "fvd"])
def _(t):
    return qa.factor_gate(day_rows(t, FACTOR_ORDER), members(t), QUALITY_GATE["min_factor_stock_coverage"])


@query("l7_hard_filter_gate", _HF_SQL, ["um", "fvd"])
def _(t):
    return qa.hard_filter_gate(day_rows(t, HARD_FILTERS), members(t), QUALITY_GATE["min_hard_filter_coverage"])


@query("l8_optional_tables_gate", _OPT_SQL, ["announcements", "riskevents"])
def _(t):
    return optional(t)


def gate(t):
    from tidemark.session import materialize

    rows = materialize(day_rows(t, FACTOR_ORDER))
    uni, px = members(t), prices_on_day(t)
    return qa.assemble_gate(
        [
            qa.calendar_gate(t.calendar, DAY),
            qa.universe_gate(uni),
            qa.kind_gate(un.kind_counts(uni)),
            qa.coverage_gate(px, uni, "daily_prices_coverage", QUALITY_GATE["min_price_coverage"]),
            qa.coverage_gate(
                t.valuations.filter(f"trade_date = DATE'{DAY}'"), uni, "valuation_daily_coverage", QUALITY_GATE["min_valuation_coverage"]
            ),
            qa.factor_gate(rows, uni, QUALITY_GATE["min_factor_stock_coverage"]),
            qa.hard_filter_gate(rows, uni, QUALITY_GATE["min_hard_filter_coverage"]),
            optional(t),
        ]
    )


@query("l9_quality_gate", _ALL_SQL, _ALL_READS)
def _(t):
    return gate(t)


@query(
    "l9_gate_status_counts",
    f"SELECT status, count(*) AS check_count, bool_or(status = 'FAIL' AND severity = 'blocking') AS blocking FROM ({_ALL_SQL}) GROUP BY 1",
    _ALL_READS,
)
def _(t):
    return qa.gate_summary(gate(t))
