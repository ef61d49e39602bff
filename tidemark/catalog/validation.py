"""G: factor validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.factors import factor_rows
from tidemark.catalog.registry import cte, query
from tidemark.functions.calendar import open_days, target_dates
from tidemark.operators import factors as fx
from tidemark.operators import validation as va
from tidemark.params import FACTORS, VALIDATION, factor_names, select_factors

H = VALIDATION["horizons"]
NAMES = ["return_20d", "volatility_20d", "pb_percentile"]
RANGE = ("1996-01-01", "2000-12-31")
SIGN = "CASE " + " ".join(
    f"WHEN factor_name = '{n}' THEN {1 if spec[1] == 'higher_is_better' else -1}"
    for n, spec in FACTORS.items()
    if spec[1] != "boolean_filter"
) + " END"

cte(
    "labels_fwd",
    f"""
    SELECT a.entity, a.trade_date, h.horizon, b.adj / nullif(a.adj, 0) - 1 AS forward_return
    FROM px a JOIN ords o ON o.trade_date = a.trade_date CROSS JOIN (VALUES {', '.join(f'({h})' for h in H)}) h(horizon)
    JOIN ords p ON p.ord = o.ord + h.horizon
    JOIN px b ON b.entity = a.entity AND b.trade_date = p.trade_date
    """,
    ["px", "ords"],
)
cte(
    "fl",
    " UNION ALL ".join(
        f"""SELECT f.entity, f.factor_name, f.trade_date, l.horizon, f.factor_value, l.forward_return
            FROM f_{n} f JOIN labels_fwd l ON l.entity = f.entity AND l.trade_date = f.trade_date"""
        for n in NAMES
    ),
    ["labels_fwd", *[f"f_{n}" for n in NAMES]],
)
cte(
    "ic",
    f"""
    SELECT factor_name, trade_date, horizon, valid_n, rank_ic, rank_ic * {SIGN} AS oriented_rank_ic
    FROM (SELECT factor_name, trade_date, horizon, count(*) AS valid_n,
                 CASE WHEN count(*) >= 3 AND max(x) > min(x) AND max(y) > min(y)
                      THEN round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 12) END AS rank_ic
          FROM (SELECT factor_name, trade_date, horizon,
                       rank() OVER (PARTITION BY factor_name, trade_date, horizon ORDER BY factor_value)
                         + (count(*) OVER (PARTITION BY factor_name, trade_date, horizon, factor_value) - 1) / 2.0 AS x,
                       rank() OVER (PARTITION BY factor_name, trade_date, horizon ORDER BY forward_return)
                         + (count(*) OVER (PARTITION BY factor_name, trade_date, horizon, forward_return) - 1) / 2.0 AS y
                FROM fl)
          GROUP BY 1, 2, 3)
    """,
    ["fl"],
)
cte(
    "grp",
    f"""
    SELECT *, top_return - bottom_return AS top_minus_bottom_return, top_return - bottom_return AS long_short_return
    FROM (SELECT factor_name, trade_date, horizon, avg(CASE WHEN b = 3 THEN forward_return END) AS top_return,
                 avg(CASE WHEN b = 0 THEN forward_return END) AS bottom_return,
                 least(count(CASE WHEN b = 3 THEN 1 END), count(CASE WHEN b = 0 THEN 1 END)) AS valid_group_size
          FROM (SELECT *, ((row_number() OVER w - 1) * 4) // n AS b
                FROM (SELECT *, factor_value * {SIGN} AS oriented,
                             count(*) OVER (PARTITION BY factor_name, trade_date, horizon) AS n FROM fl)
                WHERE n >= 4
                WINDOW w AS (PARTITION BY factor_name, trade_date, horizon ORDER BY oriented, entity))
          GROUP BY 1, 2, 3)
    """,
    ["fl"],
)


def _ratio(c: str) -> str:
    return f"CASE WHEN count({c}) > 1 AND max({c}) > min({c}) THEN avg({c}) / stddev_samp({c}) END"


def _std(c: str) -> str:
    return f"CASE WHEN count({c}) > 1 THEN stddev_samp({c}) END"


cte(
    "icsum",
    f"""
    SELECT factor_name, horizon, count(rank_ic) AS valid_ic_dates, avg(rank_ic) AS mean_rank_ic,
           {_std('rank_ic')} AS rank_ic_std, {_ratio('rank_ic')} AS icir,
           count(oriented_rank_ic) AS valid_oriented_ic_dates, avg(oriented_rank_ic) AS mean_oriented_rank_ic,
           {_std('oriented_rank_ic')} AS oriented_rank_ic_std, {_ratio('oriented_rank_ic')} AS oriented_icir
    FROM ic GROUP BY 1, 2
    """,
    ["ic"],
)
cte(
    "decay",
    f"""
    SELECT factor_name, horizon, coalesce(valid_ic_dates, 0) AS valid_ic_dates, mean_rank_ic, icir,
           mean_oriented_rank_ic, oriented_icir, coalesce(valid_group_dates, 0) AS valid_group_dates,
           mean_top_return, mean_bottom_return, mean_top_minus_bottom_return, mean_long_short_return
    FROM (SELECT factor_name, horizon, valid_ic_dates, mean_rank_ic, icir, mean_oriented_rank_ic, oriented_icir FROM icsum)
    FULL OUTER JOIN (SELECT factor_name, horizon, count(top_minus_bottom_return) AS valid_group_dates,
        avg(top_return) AS mean_top_return, avg(bottom_return) AS mean_bottom_return,
        avg(top_minus_bottom_return) AS mean_top_minus_bottom_return, avg(long_short_return) AS mean_long_short_return
        FROM grp GROUP BY 1, 2) USING (factor_name, horizon)
    """,
    ["icsum", "grp"],
)


def labels(t):
    return t.stored("labels", lambda: va.forward_labels(t.prices, t.calendar, H))


def labelled(t, names=NAMES):
    """The labelled factor rows, stored for all queries that rank them."""
    return t.stored(f"labelled|{','.join(names)}", lambda: va.with_labels(factor_rows(t, names), labels(t)))


def ic(t, names=NAMES):
    return va.rank_ic(labelled(t, names), VALIDATION["min_ic_observations"])


@query(
    "g1_target_dates",
    f"""SELECT c.trade_date, h.horizon, o.trade_date AS target_date
        FROM calgap c CROSS JOIN (VALUES {', '.join(f'({h})' for h in H)}) h(horizon)
        JOIN (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS ord FROM calgap WHERE is_open) o
          ON o.ord = (SELECT count(*) FROM calgap x WHERE x.is_open AND x.trade_date <= c.trade_date) + h.horizon""",
    ["calgap"],
    longs="horizon",
)
def _(t):
    return target_dates(t.calendar_gaps, H, t.calendar_gaps)


# A calendar from 1926 to 2106: the weeks of the table, and the same weeks moved by 25,000 and 40,000 days.
cte(
    "calwide",
    """SELECT trade_date, TRUE AS is_open FROM cal UNION SELECT trade_date - 25000, TRUE FROM cal
       UNION SELECT trade_date + 40000, TRUE FROM cal""",
    ["cal"],
)


@query(
    "g1_target_dates_wide_calendar",
    f"""SELECT s.trade_date, h.horizon, b.trade_date AS target_date
        FROM (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS k FROM calwide) s
        CROSS JOIN (VALUES {', '.join(f'({h})' for h in H)}) h(horizon)
        JOIN (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS k FROM calwide) b ON b.k = s.k + h.horizon""",
    ["calwide"],
    longs="horizon",
)
def _(t):
    wide = t.calendar.selectExpr("explode(array(trade_date, date_sub(trade_date, 25000), date_add(trade_date, 40000))) AS trade_date", "is_open")
    return target_dates(wide, H, wide)


@query("g2_forward_labels", "SELECT * FROM labels_fwd", ["labels_fwd"], doubles="forward_return", longs="horizon")
def _(t):
    return labels(t)


@query(
    "g2_forward_labels_with_closed_days",
    """SELECT a.entity, a.trade_date, 5 AS horizon, b.adj / nullif(a.adj, 0) - 1 AS forward_return
       FROM px a JOIN (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS ord FROM calgap WHERE is_open) o
         ON o.ord = (SELECT count(*) FROM calgap x WHERE x.is_open AND x.trade_date <= a.trade_date) + 5
       JOIN px b ON b.entity = a.entity AND b.trade_date = o.trade_date""",
    ["px", "calgap"],
    doubles="forward_return",
    longs="horizon",
)
def _(t):
    return va.forward_labels(t.prices, t.calendar_gaps, [5])


_LOAD_NAMES = ["return_20d", "above_ma60"]


@query(
    "g3_load_factor_values",
    f"""SELECT * FROM (SELECT * FROM f_return_20d UNION ALL SELECT * FROM f_above_ma60)
        WHERE trade_date BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}'""",
    ["f_return_20d", "f_above_ma60"],
    doubles="factor_value",
)
def _(t):
    return va.load_factor_values(factor_rows(t, _LOAD_NAMES), *RANGE, _LOAD_NAMES)


@query("g4_factor_labels", "SELECT * FROM fl", ["fl"], doubles="factor_value forward_return", longs="horizon")
def _(t):
    return va.with_labels(factor_rows(t, NAMES), labels(t))


_COVERAGE_SQL = f"""
    SELECT f.factor_name, d.trade_date, coalesce(u.n, 0) AS universe_count, coalesce(v.n, 0) AS valid_factor_count,
           greatest(coalesce(u.n, 0) - coalesce(v.n, 0), 0) AS missing_count,
           coalesce(v.n, 0) / nullif(u.n, 0) AS coverage, 1 - coalesce(v.n, 0) / nullif(u.n, 0) AS missing_rate
    FROM cal d CROSS JOIN (VALUES {', '.join(f"('{n}')" for n in NAMES)}) f(factor_name)
    LEFT JOIN (SELECT trade_date, count(DISTINCT entity) AS n FROM universe_all GROUP BY 1) u ON u.trade_date = d.trade_date
    LEFT JOIN (SELECT factor_name, trade_date, count(DISTINCT entity) AS n
               FROM ({' UNION ALL '.join(f'SELECT * FROM f_{n}' for n in NAMES)}) GROUP BY 1, 2) v
      ON v.factor_name = f.factor_name AND v.trade_date = d.trade_date
"""
cte("cover", _COVERAGE_SQL, ["cal", "universe_all", *[f"f_{n}" for n in NAMES]])


def coverage(t, names=NAMES):
    universe = fx.calculation_universe(t.members, t.securities, open_days(t.calendar), "X", include_delisted=True)
    return va.coverage(factor_rows(t, names), universe, open_days(t.calendar), names)


@query("g5_coverage", "SELECT * FROM cover", ["cover"], doubles="coverage missing_rate")
def _(t):
    return coverage(t)


@query("g6_rank_ic", "SELECT * FROM ic", ["ic"], doubles="rank_ic oriented_rank_ic", longs="horizon")
def _(t):
    return ic(t)


_SUM_DOUBLES = (
    "mean_rank_ic rank_ic_std icir mean_oriented_rank_ic oriented_rank_ic_std oriented_icir"
)


@query("g7_ic_summary", "SELECT * FROM icsum", ["icsum"], doubles=_SUM_DOUBLES, longs="horizon")
def _(t):
    return va.ic_summary(ic(t))


@query(
    "g8_group_returns",
    "SELECT * FROM grp",
    ["grp"],
    doubles="top_return bottom_return top_minus_bottom_return long_short_return",
    longs="horizon",
)
def _(t):
    return va.group_returns(labelled(t), VALIDATION["n_groups"], VALIDATION["min_group_size"])


@query(
    "g9_decay_curve",
    "SELECT * FROM decay",
    ["decay"],
    doubles="mean_rank_ic icir mean_oriented_rank_ic oriented_icir mean_top_return mean_bottom_return "
    "mean_top_minus_bottom_return mean_long_short_return",
    longs="horizon",
)
def _(t):
    base = labelled(t)
    return va.decay_curve(
        va.rank_ic(base, VALIDATION["min_ic_observations"]), va.group_returns(base, VALIDATION["n_groups"], 1)
    )


@query(
    "g10_yearly_stability",
    f"""SELECT a.*, coalesce(b.valid_group_dates, 0) AS valid_group_dates, b.mean_top_minus_bottom_label_return
        FROM (SELECT factor_name, year(trade_date) AS year, horizon, count(rank_ic) AS valid_ic_dates,
                     count(oriented_rank_ic) AS valid_oriented_ic_dates, avg(rank_ic) AS mean_rank_ic,
                     avg(oriented_rank_ic) AS mean_oriented_rank_ic, {_ratio('oriented_rank_ic')} AS oriented_icir,
                     avg(CASE WHEN oriented_rank_ic > 0 THEN 1.0 WHEN oriented_rank_ic <= 0 THEN 0.0 END) AS positive_oriented_ic_ratio
              FROM ic GROUP BY 1, 2, 3) a
        LEFT JOIN (SELECT factor_name, year(trade_date) AS year, horizon, count(DISTINCT trade_date) AS valid_group_dates,
                          avg(top_minus_bottom_return) AS mean_top_minus_bottom_label_return
                   FROM grp GROUP BY 1, 2, 3) b
          ON a.factor_name = b.factor_name AND a.year = b.year AND a.horizon = b.horizon""",
    ["ic", "grp"],
    doubles="mean_rank_ic mean_oriented_rank_ic oriented_icir positive_oriented_ic_ratio mean_top_minus_bottom_label_return",
    longs="horizon year",
)
def _(t):
    base = labelled(t)
    return va.yearly_stability(
        va.rank_ic(base, VALIDATION["min_ic_observations"]), va.group_returns(base, VALIDATION["n_groups"], 1)
    )


@query(
    "g11_label_summary",
    f"""SELECT h.horizon, count(l.forward_return) AS valid_label_count, max(l.trade_date) AS latest_usable_signal_date
        FROM (VALUES {', '.join(f'({h})' for h in [*H, 400])}) h(horizon) LEFT JOIN labels_fwd l ON l.horizon = h.horizon
        GROUP BY 1""",
    ["labels_fwd"],
    longs="horizon",
)
def _(t):
    # A horizon longer than the calendar has no labels and still gets its row.
    return va.label_summary(labels(t), [*H, 400])


RUN_SQL = """SELECT 'label_summary' AS frame, count(DISTINCT horizon) AS n FROM labels_fwd
       UNION ALL SELECT 'coverage', count(*) FROM cover UNION ALL SELECT 'rank_ic', count(*) FROM ic
       UNION ALL SELECT 'ic_summary', count(*) FROM icsum UNION ALL SELECT 'group_returns', count(*) FROM grp
       UNION ALL SELECT 'decay_curve', count(*) FROM decay
       UNION ALL SELECT 'yearly_ic_summary', count(*) FROM (SELECT DISTINCT factor_name, year(trade_date), horizon FROM ic)"""
RUN_READS = ["labels_fwd", "cover", "ic", "icsum", "grp", "decay"]


def validation_frames(t):
    universe = fx.calculation_universe(t.members, t.securities, open_days(t.calendar), "X", include_delisted=True)
    rows = t.stored("validation_rows", lambda: factor_rows(t, [*NAMES, "is_st"]))
    return va.validate(rows, t.prices, t.calendar, universe, NAMES, H, 4, 3)


@query("g12_validation_run", RUN_SQL, RUN_READS)
def _(t):
    out = None
    for name, df in validation_frames(t).items():
        part = df.agg(F.expr(f"'{name}' AS frame"), F.expr("count(*) AS n"))
        out = part if out is None else out.unionByName(part)
    return out


_META = " UNION ALL ".join(
    f"SELECT '{n}' AS factor_name, '{k}' AS factor_type, '{d}' AS direction, '{g}' AS score_group"
    for n, (k, d, g) in FACTORS.items()
)


@query(
    "g13_factor_metadata_of_rows",
    f"""SELECT m.factor_type, m.direction, m.score_group, f.factor_name, count(*) AS n
        FROM fv f JOIN ({_META}) m ON m.factor_name = f.factor_name WHERE m.factor_type = 'factor' GROUP BY 1, 2, 3, 4""",
    ["fv"],
)
def _(t):
    assert select_factors(None) == factor_names()
    rows = factor_rows(t, select_factors(None))
    counts = rows.groupBy("factor_name").agg(F.expr("count(*) AS n"))
    return counts.join(va.metadata(t.spark), "factor_name")
