"""I: candidate scan and targets (all month-end signal dates at once)."""

from __future__ import annotations

from tidemark.catalog.factors import factor_rows
from tidemark.catalog.registry import cte, query
from tidemark.functions.calendar import month_ends
from tidemark.operators import asof
from tidemark.operators import selection as se
from tidemark.params import HARD_FILTERS

SORT = "return_20d"
DISPLAY = ["return_20d", "pe_ttm_percentile", "return_60d", "above_ma60"]
NAMES = [*DISPLAY, *HARD_FILTERS]
TOP_N = 10
RUN = "run_a"

cte(
    "wide",
    "SELECT entity, trade_date, "
    + ", ".join(f"max(CASE WHEN factor_name = '{n}' THEN factor_value END) AS {n}" for n in NAMES)
    + f" FROM ({' UNION ALL '.join(f'SELECT * FROM f_{n}' for n in NAMES)}) WHERE trade_date IN (SELECT trade_date FROM monthends) GROUP BY 1, 2",
    ["monthends", *[f"f_{n}" for n in NAMES]],
)
_PASS = " AND ".join(f"coalesce({n} = 0, FALSE)" for n in HARD_FILTERS)
cte(
    "scan",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY {SORT} DESC, entity) AS rank
        FROM wide WHERE {_PASS} AND {SORT} IS NOT NULL) WHERE rank <= {TOP_N}""",
    ["wide"],
)
cte(
    "enriched",
    """SELECT s.*, x.name, i.industry_l1, i.industry_l2 FROM scan s
       LEFT JOIN securities x ON x.entity = s.entity AND x.list_date <= s.trade_date
       LEFT JOIN ind_on i ON i.entity = s.entity AND i.trade_date = s.trade_date""",
    ["scan", "securities", "ind_on"],
)
_DOUBLES = " ".join(NAMES)


def signals(t):
    return month_ends(t.calendar).selectExpr("signal_date AS trade_date")


def wide(t):
    return se.to_wide(factor_rows(t, NAMES, signals(t)), NAMES)


def enriched(t):
    return se.enrich(
        se.scan(wide(t), SORT, TOP_N), t.securities, asof.intervals_on_dates(t.industries, signals(t))
    )


def candidates(t):
    return se.candidate_frame(enriched(t), SORT, DISPLAY, TOP_N, RUN)


@query("i1_wide_factors", "SELECT * FROM wide", ["wide"], doubles=_DOUBLES)
def _(t):
    return wide(t)


@query(
    "i2_hard_filter_mask",
    f"SELECT entity, trade_date, {_PASS} AS passed FROM wide",
    ["wide"],
)
def _(t):
    return wide(t).selectExpr("entity", "trade_date", f"{se.passes_filters()} AS passed")


@query("i3_top_candidates", "SELECT * FROM scan", ["scan"], doubles=_DOUBLES)
def _(t):
    return se.scan(wide(t), SORT, TOP_N)


@query("i4_enriched_candidates", "SELECT * FROM enriched", ["enriched"], doubles=_DOUBLES)
def _(t):
    return enriched(t)


_TIPS = ", ".join(
    [
        f"'{se.MISSING_TEXT}' || nullif(concat_ws(', ', {', '.join(f'''CASE WHEN {n} IS NULL THEN '{n}' END''' for n in DISPLAY)}), '')",
        *[f"CASE WHEN {rule.replace('0.8D', '0.8')} THEN '{text}' END" for rule, text in se.TIPS if rule.split()[0] in DISPLAY],
    ]
)
cte(
    "cands",
    f"""SELECT rank, entity, name, industry_l1, industry_l2, trade_date AS as_of_date, '{RUN}' AS source_run_id,
               '{SORT}' AS sort_factor, {SORT} AS sort_factor_value,
               {', '.join(f'{n} AS factor__{n}' for n in DISPLAY)},
               {', '.join(f'{n} AS hard_filter__{n}' for n in HARD_FILTERS)},
               '按 {SORT} higher_is_better 排序进入 Top {TOP_N}；{SORT}=' || printf('%.4f', {SORT}) || '；硬过滤均通过。' AS selection_reason,
               coalesce(nullif(concat_ws('；', {_TIPS}), ''), '{se.NO_RISK_TEXT}') AS risk_tips
        FROM enriched""",
    ["enriched"],
)


@query(
    "i5_candidate_frame",
    "SELECT * FROM cands",
    ["cands"],
    doubles="sort_factor_value " + " ".join([f"factor__{n}" for n in DISPLAY] + [f"hard_filter__{n}" for n in HARD_FILTERS]),
)
def _(t):
    return candidates(t)


_VERSIONS = """SELECT entity, trade_date, factor_name, factor_value, as_of_date, 'run_a' AS source_run_id FROM f_return_20d
    UNION ALL SELECT entity, trade_date, factor_name, factor_value * 1.01, CAST(as_of_date + 7 AS DATE), 'run_a'
    FROM f_return_20d WHERE entity % 2 = 0"""
_KNOWN_ON = "1999-06-07"


@query(
    "i6_latest_factor_version",
    f"""SELECT * FROM ({_VERSIONS}) WHERE as_of_date <= DATE '{_KNOWN_ON}'
        QUALIFY row_number() OVER (PARTITION BY entity, trade_date, factor_name ORDER BY as_of_date DESC) = 1""",
    ["f_return_20d"],
    doubles="factor_value",
)
def _(t):
    rows = factor_rows(t, [SORT])
    versions = rows.selectExpr(
        "entity", "trade_date", "factor_name",
        "explode(CASE WHEN entity % 2 = 0 THEN array(0, 7) ELSE array(0) END) AS late", "factor_value", "as_of_date",
    ).selectExpr(
        "entity", "trade_date", "factor_name",
        "CASE WHEN late = 7 THEN factor_value * 1.01D ELSE factor_value END AS factor_value",
        "date_add(as_of_date, late) AS as_of_date", f"'{RUN}' AS source_run_id",
    )
    return se.latest_versions(versions, _KNOWN_ON)


@query(
    "i6_repeated_versions",
    f"SELECT '{RUN}' AS source_run_id, entity, trade_date, factor_name, as_of_date, 2 AS row_count FROM f_{SORT} WHERE entity % 10 = 3",
    [f"f_{SORT}"],
    longs="row_count",
)
def _(t):
    copies = "explode(CASE WHEN entity % 10 = 3 THEN array(1, 2) ELSE array(1) END) AS c"
    return se.repeated_versions(factor_rows(t, [SORT]).selectExpr("*", f"'{RUN}' AS source_run_id", copies))


@query(
    "i7_signal_dates_with_rows",
    "SELECT trade_date AS signal_date FROM monthends WHERE trade_date IN (SELECT trade_date FROM f_return_60d)",
    ["monthends", "f_return_60d"],
)
def _(t):
    return se.dates_with_rows(month_ends(t.calendar).select("signal_date"), factor_rows(t, ["return_60d"]))


cte(
    "targets",
    f"""SELECT trade_date AS signal_date, entity, rank, {SORT} AS sort_factor_value,
               1.0 / count(*) OVER (PARTITION BY trade_date) AS target_weight FROM scan""",
    ["scan"],
)


@query(
    "i8_equal_weight_targets", "SELECT * FROM targets", ["targets"], doubles="sort_factor_value target_weight"
)
def _(t):
    return se.equal_weight_targets(wide(t), SORT, TOP_N)
