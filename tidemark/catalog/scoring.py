"""J: composite scoring over all month-end signal dates."""

from __future__ import annotations

import copy

from pyspark.sql import functions as F

from tidemark.catalog import validation as vc
from tidemark.catalog.factors import factor_rows
from tidemark.catalog.registry import cte, query
from tidemark.functions.calendar import month_ends
from tidemark.functions.ranks import largest_group
from tidemark.operators import factors as fx
from tidemark.operators import scoring as sc
from tidemark.operators import validation as va
from tidemark.params import FACTORS, HARD_FILTERS, SCORING, VALIDATION, config_rows
from tidemark.session import materialize

SCORED = [n for n, _, _, _ in config_rows()]
NAMES = [*SCORED, *HARD_FILTERS]
TOP_N = 10
# Variant with one required group, to exercise the exclusion rule.
STRICT = copy.deepcopy(SCORING)
STRICT["groups"]["financial"]["required"] = True
STRICT["groups"]["valuation"]["required"] = True


def store(t):
    """Factor rows of all month ends, stored for all scoring queries."""
    return t.stored("score_store", lambda: factor_rows(t, NAMES, signals(t)))


def signals(t):
    return month_ends(t.calendar).selectExpr("signal_date AS trade_date")


def universe(t):
    return fx.calculation_universe(t.members, t.securities, signals(t), "X", include_delisted=True)


def scores(t, scoring=SCORING):
    """Composite frames; what many branches read is stored once for all queries."""
    base = store(t)
    kept = t.stored("score_passed", lambda: sc.passed(base, universe(t)), plain=True)
    largest = largest_group(kept, ["trade_date"])
    variant = "strict" if scoring is STRICT else "default" if scoring is SCORING else repr(scoring)
    normalized = t.stored(
        f"score_normalized|{variant}",
        lambda: sc.normalized_scores(sc.score_inputs(base, kept, SCORED), scoring, largest),
    )
    grouped = sc.group_scores(sc.wide_scores(normalized, kept, scoring), scoring)
    return {
        "store": base, "passed": kept, "normalized": normalized, "grouped": grouped, "totals": sc.totals(grouped, scoring),
        "largest": largest,
    }


cte(
    "fvm",
    " UNION ALL ".join(f"SELECT * FROM f_{n} WHERE trade_date IN (SELECT trade_date FROM monthends)" for n in NAMES),
    ["monthends", *[f"f_{n}" for n in NAMES]],
)
cte("unim", "SELECT * FROM universe_all WHERE trade_date IN (SELECT trade_date FROM monthends)", ["universe_all", "monthends"])
_FILTERS = ", ".join(f"'{n}'" for n in HARD_FILTERS)
cte(
    "excl",
    f"""SELECT u.entity, u.trade_date, f.hard_filter_name, v.factor_value,
               CASE WHEN v.factor_value IS NULL THEN 'missing_hard_filter' ELSE 'failed_hard_filter' END AS exclusion_reason
        FROM unim u CROSS JOIN (SELECT unnest([{_FILTERS}]) AS hard_filter_name) f
        LEFT JOIN fvm v ON v.entity = u.entity AND v.trade_date = u.trade_date AND v.factor_name = f.hard_filter_name
        WHERE v.factor_value IS NULL OR v.factor_value <> 0""",
    ["unim", "fvm"],
)
cte(
    "passed",
    "SELECT u.* FROM unim u ANTI JOIN excl e ON e.entity = u.entity AND e.trade_date = u.trade_date",
    ["unim", "excl"],
)
_SCORED = ", ".join(f"'{n}'" for n in SCORED)
_FLIP = ", ".join(
    f"'{n}'" for n, s in FACTORS.items() if s[1] == "lower_is_better" and n not in SCORING["risk"]["factors"]
)
cte(
    "norm",
    f"""SELECT entity, trade_date, factor_name, factor_value AS raw_factor_value,
               CASE WHEN n = 1 THEN 50.0 WHEN ties = n THEN 50.0 ELSE 100 * (rk + (ties - 1) / 2.0 - 1) / (n - 1) END AS normalized_score
        FROM (SELECT *, rank() OVER (PARTITION BY trade_date, factor_name ORDER BY o) AS rk,
                     count(*) OVER (PARTITION BY trade_date, factor_name, o) AS ties,
                     count(*) OVER (PARTITION BY trade_date, factor_name) AS n
              FROM (SELECT v.*, v.factor_value * CASE WHEN v.factor_name IN ({_FLIP}) THEN -1 ELSE 1 END AS o
                    FROM fvm v JOIN passed p ON p.entity = v.entity AND p.trade_date = v.trade_date
                    WHERE v.factor_name IN ({_SCORED})))""",
    ["fvm", "passed"],
)
_CONFIG = " UNION ALL ".join(
    f"SELECT '{n}' AS factor_name, '{r}' AS score_role, '{g}' AS score_group, CAST({w} AS DOUBLE) AS factor_weight"
    for n, r, g, w in config_rows()
)
cte("cfg", _CONFIG)
cte(
    "deco",
    """SELECT n.*, c.score_role, c.score_group, c.factor_weight, n.normalized_score * c.factor_weight AS weighted_contribution,
              'PASS' AS validation_status FROM norm n JOIN cfg c ON c.factor_name = n.factor_name""",
    ["norm", "cfg"],
)
_GROUPS = "(VALUES ('financial', 0.30), ('valuation', 0.30), ('momentum', 0.40)) g(score_group, group_weight)"
cte(
    "grouped",
    f"""SELECT p.entity, p.trade_date, g.score_group, CAST(g.group_weight AS DOUBLE) AS group_weight,
               coalesce(d.avail, 0) AS avail, z.n - coalesce(d.n, 0) AS missing,
               CASE WHEN d.avail >= 0.5 THEN least(greatest(d.total / d.avail, 0), 100) END AS group_score
        FROM passed p CROSS JOIN {_GROUPS}
        JOIN (SELECT score_group, count(*) AS n FROM cfg GROUP BY 1) z ON z.score_group = g.score_group
        LEFT JOIN (SELECT entity, trade_date, score_group, sum(factor_weight) AS avail, sum(weighted_contribution) AS total,
                          count(*) AS n FROM deco GROUP BY 1, 2, 3) d
          ON d.entity = p.entity AND d.trade_date = p.trade_date AND d.score_group = g.score_group""",
    ["passed", "cfg", "deco"],
)
cte(
    "penalty",
    """SELECT entity, trade_date, CASE WHEN sum(factor_weight) >= 0.5
              THEN least(15.0, sum(normalized_score * factor_weight) / sum(factor_weight) / 100 * 15.0) ELSE 0.0 END AS risk_penalty
       FROM deco WHERE score_role = 'risk_penalty' GROUP BY 1, 2""",
    ["deco"],
)
cte(
    "total",
    """SELECT p.entity, p.trade_date, p.financial_score, p.valuation_score, p.momentum_score,
              least(greatest(positive, 0), 100) AS positive_score, coalesce(r.risk_penalty, 0.0) AS risk_penalty,
              least(greatest(positive - coalesce(r.risk_penalty, 0.0), 0), 100) AS total_score
       FROM (SELECT entity, trade_date, max(CASE WHEN score_group = 'financial' THEN group_score END) AS financial_score,
                    max(CASE WHEN score_group = 'valuation' THEN group_score END) AS valuation_score,
                    max(CASE WHEN score_group = 'momentum' THEN group_score END) AS momentum_score,
                    sum(CASE WHEN group_score IS NOT NULL THEN group_score * group_weight END)
                      / nullif(sum(CASE WHEN group_score IS NOT NULL THEN group_weight END), 0) AS positive
             FROM grouped GROUP BY 1, 2) p
       LEFT JOIN penalty r ON r.entity = p.entity AND r.trade_date = p.trade_date
       WHERE positive IS NOT NULL""",
    ["grouped", "penalty"],
)
cte(
    "ranked",
    "SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY total_score DESC, entity) AS rank FROM total",
    ["total"],
)
_TOTAL_DOUBLES = "financial_score valuation_score momentum_score positive_score risk_penalty total_score"


@query(
    "j1_score_inputs",
    f"SELECT v.* FROM fvm v JOIN unim u ON u.entity = v.entity AND u.trade_date = v.trade_date WHERE factor_name IN ({_SCORED})",
    ["fvm", "unim"],
    doubles="factor_value",
)
def _(t):
    return sc.score_inputs(factor_rows(t, SCORED, signals(t)), universe(t), SCORED)


@query("j2_hard_filter_exclusions", "SELECT * FROM excl", ["excl"], doubles="factor_value")
def _(t):
    return sc.hard_filter_exclusions(factor_rows(t, HARD_FILTERS, signals(t)), universe(t))


@query("j3_normalized_scores", "SELECT * FROM norm", ["norm"], doubles="raw_factor_value normalized_score")
def _(t):
    return scores(t)["normalized"]


@query(
    "j4_decorated_scores",
    "SELECT * FROM deco",
    ["deco"],
    doubles="raw_factor_value normalized_score factor_weight weighted_contribution",
)
def _(t):
    return sc.decorate(scores(t)["normalized"])


@query(
    "j5_group_breakdown",
    """SELECT entity, trade_date, score_group, TRUE AS group_enabled, FALSE AS group_required, group_weight, group_score,
              group_score * group_weight AS weighted_contribution, avail AS available_factor_weight, missing AS missing_factor_count
       FROM grouped
       UNION ALL SELECT entity, trade_date, 'event', FALSE, FALSE, 0.0, NULL, 0.0, 0.0, 0 FROM passed""",
    ["grouped", "passed"],
    doubles="group_weight group_score weighted_contribution available_factor_weight",
    longs="missing_factor_count",
)
def _(t):
    return sc.breakdown(scores(t)["grouped"])


@query(
    "j6_score_exclusions",
    """SELECT entity, trade_date, CASE WHEN bool_or(score_group IN ('financial', 'valuation') AND group_score IS NULL)
              THEN 'required_group_unavailable' ELSE 'no_group_available' END AS reason
       FROM grouped GROUP BY 1, 2
       HAVING bool_or(score_group IN ('financial', 'valuation') AND group_score IS NULL) OR count(group_score) = 0""",
    ["grouped"],
)
def _(t):
    return sc.score_exclusions(scores(t, STRICT)["grouped"], STRICT)


@query(
    "j7_positive_score",
    "SELECT entity, trade_date, positive_score FROM total",
    ["total"],
    doubles="positive_score",
)
def _(t):
    return scores(t)["totals"].select("entity", "trade_date", "positive_score")


@query(
    "j8_risk_penalty", "SELECT entity, trade_date, risk_penalty FROM total", ["total"], doubles="risk_penalty"
)
def _(t):
    return scores(t)["totals"].select("entity", "trade_date", "risk_penalty")


@query("j9_ranked_scores", "SELECT * FROM ranked", ["ranked"], doubles=_TOTAL_DOUBLES)
def _(t):
    frames = scores(t)
    return sc.ranked(frames["totals"], largest=frames["largest"])


_GATE_REASONS = """[CASE WHEN v.coverage IS NULL THEN 'factor missing from coverage.csv' END,
    CASE WHEN v.coverage < 0.2 THEN 'coverage ' || CAST(round(v.coverage, 6) AS VARCHAR) || ' below minimum 0.2' END,
    CASE WHEN i.horizon IS NULL THEN 'missing ic_summary horizon 20' END,
    CASE WHEN i.valid_oriented_ic_dates < 1 THEN 'horizon 20 valid_oriented_ic_dates below minimum' END,
    CASE WHEN i.horizon IS NOT NULL AND coalesce(i.mean_oriented_rank_ic, -1) < 0 THEN 'horizon 20 mean_oriented_rank_ic below minimum' END,
    CASE WHEN i.horizon IS NOT NULL AND coalesce(g.n, 0) = 0 THEN 'horizon 20 missing group_returns rows' END]"""
cte(
    "gate",
    f"""SELECT factor_name, score_role, score_group, TRUE AS configured_enabled,
               CASE WHEN len(parts) > 0 THEN 'FAIL' ELSE 'PASS' END AS validation_status,
               CASE WHEN len(parts) > 0 THEN array_to_string(parts, '; ') ELSE 'passed' END AS reason,
               '20' AS required_horizons, coverage, valid_oriented_ic_dates, mean_oriented_rank_ic, oriented_icir, group_return_rows
        FROM (SELECT c.factor_name, c.score_role, c.score_group, v.coverage, i.valid_oriented_ic_dates, i.mean_oriented_rank_ic,
                     i.oriented_icir, coalesce(g.n, 0) AS group_return_rows, list_filter({_GATE_REASONS}, lambda x: x IS NOT NULL) AS parts
              FROM cfg c LEFT JOIN (SELECT factor_name, avg(coverage) AS coverage FROM cover GROUP BY 1) v ON v.factor_name = c.factor_name
              LEFT JOIN (SELECT * FROM icsum WHERE horizon = 20) i ON i.factor_name = c.factor_name
              LEFT JOIN (SELECT factor_name, count(*) AS n FROM grp WHERE horizon = 20 GROUP BY 1) g ON g.factor_name = c.factor_name)""",
    ["cfg", "cover", "icsum", "grp"],
)


def gate(t):
    base = vc.labelled(t)
    ics = va.ic_summary(va.rank_ic(base, VALIDATION["min_ic_observations"]))
    groups = va.group_returns(base, VALIDATION["n_groups"], VALIDATION["min_group_size"])
    return sc.validation_gate(vc.coverage(t), ics, groups)


@query(
    "j10_eligible_factors",
    """SELECT factor_name, score_role, validation_status = 'PASS' AS eligible,
              CASE WHEN validation_status <> 'PASS' THEN 'Skipping factor that did not pass validation gate: ' || factor_name END AS warning
       FROM gate""",
    ["gate"],
)
def _(t):
    return sc.eligible_factors(gate(t))


@query(
    "j11_validation_gate",
    "SELECT * FROM gate",
    ["gate"],
    doubles="coverage mean_oriented_rank_ic oriented_icir",
)
def _(t):
    return gate(t)


def _scenario_sql() -> str:
    """Scenario weights as rows: (scenario, group, group weight, factor, factor weight)."""
    rows = []
    for name, config in [("baseline", SCORING)] + [(s["name"], s["config"]) for s in sc.scenarios()]:
        for group, spec in config["groups"].items():
            for factor, w in spec["factors"].items():
                rows.append(f"('{name}', '{group}', {spec['weight']!r}::DOUBLE, '{factor}', {w!r}::DOUBLE)")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) s(scenario_name, score_group, gw, factor_name, fw)"


cte("scen", _scenario_sql())
cte(
    "scentotal",
    """SELECT s.scenario_name, s.entity, s.trade_date,
              least(greatest(sum(gs * gw) / sum(gw) - coalesce(max(r.risk_penalty), 0), 0), 100) AS total_score
       FROM (SELECT scenario_name, entity, trade_date, score_group, gw, least(greatest(sum(normalized_score * fw) / sum(fw), 0), 100) AS gs
             FROM norm JOIN scen USING (factor_name) GROUP BY 1, 2, 3, 4, 5 HAVING sum(fw) >= 0.5) s
       LEFT JOIN penalty r ON r.entity = s.entity AND r.trade_date = s.trade_date GROUP BY 1, 2, 3""",
    ["norm", "scen", "penalty"],
)
_DESCRIBED = ", ".join(f"('{s['name']}', '{s['type']}', '{s['key']}', '{s['direction']}')" for s in sc.scenarios())
cte(
    "scenrank",
    "SELECT *, row_number() OVER (PARTITION BY scenario_name, trade_date ORDER BY total_score DESC, entity) AS rank FROM scentotal",
    ["scentotal"],
)


@query(
    "j13_weight_sensitivity",
    f"""SELECT m.scenario_name, m.trade_date, d.scenario_type, d.changed_key, d.change_direction, 0.1 AS change_pct, {TOP_N} AS top_n,
               b.n AS baseline_candidate_count, m.n AS scenario_candidate_count,
               CASE WHEN s.common >= 2 THEN s.corr END AS spearman_rank_corr, coalesce(s.overlap, 0) AS top_n_overlap_count,
               coalesce(s.overlap, 0) / least({TOP_N}, b.n) AS top_n_overlap_ratio,
               CASE WHEN s.common >= 2 THEN s.mx END AS max_abs_rank_change, CASE WHEN s.common >= 2 THEN s.me END AS mean_abs_score_change,
               CASE WHEN coalesce(s.common, 0) < 2 THEN 'Candidate count below 2; rank correlation is NaN.' ELSE '' END AS warning
        FROM (SELECT scenario_name, trade_date, count(*) AS n FROM scenrank WHERE scenario_name <> 'baseline' GROUP BY 1, 2) m
        JOIN (SELECT trade_date, count(*) AS n FROM scenrank WHERE scenario_name = 'baseline' GROUP BY 1) b ON b.trade_date = m.trade_date
        JOIN (VALUES {_DESCRIBED}) d(scenario_name, scenario_type, changed_key, change_direction) ON d.scenario_name = m.scenario_name
        LEFT JOIN (SELECT scenario_name, trade_date, count(*) AS common,
                          CASE WHEN count(*) > 1 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS corr,
                          count(CASE WHEN r <= {TOP_N} AND br <= {TOP_N} THEN 1 END) AS overlap, max(abs(br - r)) AS mx, avg(abs(bs - ts)) AS me
                   FROM (SELECT o.scenario_name, o.trade_date, o.rank AS r, z.rank AS br, o.total_score AS ts, z.total_score AS bs,
                                row_number() OVER (PARTITION BY o.scenario_name, o.trade_date ORDER BY o.rank) AS x,
                                row_number() OVER (PARTITION BY o.scenario_name, o.trade_date ORDER BY z.rank) AS y
                         FROM scenrank o JOIN scenrank z ON z.scenario_name = 'baseline' AND z.entity = o.entity AND z.trade_date = o.trade_date
                         WHERE o.scenario_name <> 'baseline') GROUP BY 1, 2) s
          ON s.scenario_name = m.scenario_name AND s.trade_date = m.trade_date""",
    ["scenrank"],
    doubles="change_pct spearman_rank_corr top_n_overlap_ratio max_abs_rank_change mean_abs_score_change",
    longs="top_n",
)
def _(t):
    frames = scores(t)
    wide = sc.wide_scores(frames["normalized"], frames["passed"])
    return sc.weight_sensitivity(materialize(sc.scenario_totals(wide)), TOP_N)


cte(
    "scorelab",
    """SELECT s.entity, s.trade_date, s.total_score, l.horizon, l.forward_return FROM total s
       JOIN labels_fwd l ON l.entity = s.entity AND l.trade_date = s.trade_date WHERE l.horizon IN (5, 20)""",
    ["total", "labels_fwd"],
)


@query(
    "j14_yearly_score_stability",
    """SELECT y.year, y.horizon, coalesce(a.signal_date_count, 0) AS signal_date_count,
              coalesce(a.stock_observation_count, 0) AS stock_observation_count, a.rank_ic_mean, a.rank_ic_std, a.rank_icir,
              a.top_bottom_spread_mean, a.positive_rank_ic_rate,
              CASE WHEN coalesce(a.signal_date_count, 0) >= 1 THEN 'ok' ELSE 'insufficient' END AS status,
              CASE WHEN coalesce(a.signal_date_count, 0) < 1 THEN 'signal_date_count 0 below minimum 1' ELSE '' END AS warning
       FROM (SELECT DISTINCT year(trade_date) AS year, h.horizon FROM monthends CROSS JOIN (VALUES (5), (20)) h(horizon)) y
       LEFT JOIN (SELECT year(trade_date) AS year, horizon, count(*) AS signal_date_count, sum(n) AS stock_observation_count,
                         avg(ic) AS rank_ic_mean, CASE WHEN count(ic) > 1 THEN stddev_samp(ic) END AS rank_ic_std,
                         CASE WHEN count(ic) > 1 THEN avg(ic) / nullif(stddev_samp(ic), 0) END AS rank_icir,
                         avg(spread) AS top_bottom_spread_mean,
                         avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic <= 0 THEN 0.0 END) AS positive_rank_ic_rate
                  FROM (SELECT trade_date, horizon, count(*) AS n,
                               CASE WHEN count(*) >= 2 AND max(x) > min(x) AND max(y) > min(y)
                                    THEN round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 12) END AS ic,
                               CASE WHEN count(*) >= 2 THEN avg(CASE WHEN rn > n0 - greatest(1, n0 // 5) THEN forward_return END)
                                 - avg(CASE WHEN rn <= greatest(1, n0 // 5) THEN forward_return END) END AS spread
                        FROM (SELECT *, rank() OVER (PARTITION BY trade_date, horizon ORDER BY total_score)
                                       + (count(*) OVER (PARTITION BY trade_date, horizon, total_score) - 1) / 2.0 AS x,
                                     rank() OVER (PARTITION BY trade_date, horizon ORDER BY forward_return)
                                       + (count(*) OVER (PARTITION BY trade_date, horizon, forward_return) - 1) / 2.0 AS y,
                                     row_number() OVER (PARTITION BY trade_date, horizon ORDER BY total_score, entity) AS rn,
                                     count(*) OVER (PARTITION BY trade_date, horizon) AS n0
                              FROM scorelab) GROUP BY 1, 2) GROUP BY 1, 2) a ON a.year = y.year AND a.horizon = y.horizon""",
    ["scorelab", "monthends"],
    doubles="rank_ic_mean rank_ic_std rank_icir top_bottom_spread_mean positive_rank_ic_rate",
    longs="year horizon stock_observation_count",
)
def _(t):
    labels = vc.labels(t).filter("horizon IN (5, 20)")
    return sc.yearly_score_stability(scores(t)["totals"], labels, signals(t), [5, 20])
