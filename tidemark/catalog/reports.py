"""N: evidence roll-ups of one report date for all entities or a watch-list."""

from __future__ import annotations

from tidemark.catalog import events as evc
from tidemark.catalog import portfolio as pfc
from tidemark.catalog import scoring as scc
from tidemark.catalog import selection as sel
from tidemark.catalog import validation as vac
from tidemark.catalog.factors import PARAMS, factor_rows
from tidemark.catalog.registry import cte, query
from tidemark.functions.calendar import open_days
from tidemark.operators import asof
from tidemark.operators import events as ev
from tidemark.operators import portfolio as pf
from tidemark.operators import factors as fx
from tidemark.operators import reports as rp
from tidemark.operators import scoring as sc
from tidemark.operators import selection as se
from tidemark.operators import validation as va
from tidemark.params import FACTORS, HARD_FILTERS, VALIDATION
from tidemark.session import materialize

DAY, BEFORE = "1999-11-29", "1999-10-25"
DAYS, TOP_N = 30, 10
NAMES = list(dict.fromkeys([*scc.NAMES, *sel.NAMES]))


def day_rows(t, day=DAY, names=NAMES):
    """Factor rows of a report date, stored for all reports."""
    return t.stored(f"day_rows|{day}|{','.join(names)}", lambda: fx.range_factors(t, t.history, day, day, names, params=PARAMS))


def watch(t):
    return t.raw("supplier").filter("s_suppkey % 3 = 0").selectExpr("s_suppkey AS entity")


cte("watch", "SELECT s_suppkey AS entity FROM supplier WHERE s_suppkey % 3 = 0")


def candidates(t, rows, day=DAY):
    wide = se.to_wide(rows, sel.NAMES)
    days = open_days(t.calendar, day, day)
    enriched = se.enrich(se.scan(wide, sel.SORT, TOP_N), t.securities, asof.intervals_on_dates(t.industries, days))
    return se.candidate_frame(enriched, sel.SORT, sel.DISPLAY, TOP_N, "run_a")


def scored(t, rows):
    """Scores of the report date with reason and tips, plus the frames behind them."""
    uni = asof.members_as_of(t.members, DAY, "X").selectExpr("entity", f"DATE'{DAY}' AS trade_date").distinct()
    kept = materialize(sc.passed(rows, uni))
    largest = kept.count()
    normalized = materialize(sc.normalized_scores(sc.score_inputs(rows, kept, scc.SCORED), largest=largest))
    grouped = sc.group_scores(sc.wide_scores(normalized, kept))
    ranked = sc.ranked(sc.totals(grouped), largest=largest).selectExpr(
        "*", f"{sc.score_reason()} AS selection_reason", f"{sc.score_tips()} AS risk_tips"
    )
    return {
        "scores": materialize(ranked), "decorated": sc.decorate(normalized), "grouped": grouped,
        "exclusions": sc.hard_filter_exclusions(rows, uni),
    }


cte(
    "sday",
    f"""SELECT *, '综合评分排名第 ' || rank || '；total_score=' || printf('%.4f', total_score) || '；硬过滤均通过；仅通过验证门槛的因子进入评分。' AS selection_reason,
               CASE WHEN risk_penalty > 0 THEN '软风险扣分 ' || printf('%.4f', risk_penalty) || ' 分' ELSE '{sc.NO_PENALTY_TEXT}' END AS risk_tips
        FROM ranked WHERE trade_date = DATE '{DAY}'""",
    ["ranked"],
)
cte("cday", f"SELECT * FROM cands WHERE as_of_date = DATE '{DAY}'", ["cands"])
cte("cprev", f"SELECT * FROM cands WHERE as_of_date = DATE '{BEFORE}'", ["cands"])
cte("xday", f"SELECT * FROM excl WHERE trade_date = DATE '{DAY}'", ["excl"])
cte(
    "nann",
    f"""SELECT 'announcement' AS source_type, entity, effective_date AS evidence_date, announcement_type AS evidence_type, 'info' AS severity,
               CASE WHEN announcement_id % 9 <> 0 THEN 'Summary ' || CAST(announcement_id AS VARCHAR) ELSE title END AS summary,
               CAST(announcement_id AS VARCHAR) AS evidence_id
        FROM announcements WHERE publish_time <= DATE '{DAY}' AND effective_date BETWEEN DATE '{DAY}' - {DAYS} AND DATE '{DAY}'""",
    ["announcements"],
)
cte(
    "nrisk",
    f"""SELECT 'risk_event' AS source_type, entity, effective_date AS evidence_date, event_type AS evidence_type, 'warning' AS severity,
               'Risk event: ' || event_type AS summary, CAST(event_id AS VARCHAR) AS evidence_id
        FROM riskevents WHERE publish_time <= DATE '{DAY}' AND effective_date BETWEEN DATE '{DAY}' - {DAYS} AND DATE '{DAY}'""",
    ["riskevents"],
)
_X = """SELECT '{0}' AS source_type, entity, trade_date AS evidence_date, hard_filter_name AS evidence_type, 'blocking' AS severity,
        exclusion_reason AS summary, '' AS evidence_id FROM xday"""
_TIPS = f"""SELECT 'score_risk' AS source_type, entity, DATE '{DAY}' AS evidence_date, 'risk_tips' AS evidence_type, 'warning' AS severity,
        risk_tips AS summary, '' AS evidence_id FROM sday"""
cte(
    "nevid",
    f"""{_X.format('hard_filter')} UNION ALL {_TIPS} WHERE risk_tips <> '{sc.NO_PENALTY_TEXT}'
        UNION ALL SELECT * FROM (SELECT * FROM nann UNION ALL SELECT * FROM nrisk) WHERE entity IN (SELECT entity FROM cday)""",
    ["xday", "sday", "nann", "nrisk", "cday"],
)


def ann(t):
    return rp.recent_announcements(t.announcements, t.parsed_results, DAY, DAYS)


def risk(t):
    return rp.recent_risk_events(t.risk_events, DAY, DAYS)


@query(
    "n1_candidates_with_scores",
    """SELECT c.rank, c.entity, c.name, c.industry_l1, c.industry_l2, c.selection_reason, c.risk_tips, s.rank AS score_rank,
              s.total_score, s.risk_penalty, CASE WHEN s.entity IS NOT NULL THEN TRUE END AS hard_filter_passed
       FROM cday c LEFT JOIN sday s ON s.entity = c.entity""",
    ["cday", "sday"],
    doubles="total_score risk_penalty",
)
def _(t):
    rows = day_rows(t)
    return rp.candidates_with_scores(candidates(t, rows), scored(t, rows)["scores"], TOP_N)


@query("n2_top_scores", "SELECT * FROM sday WHERE rank <= 20", ["sday"], doubles=scc._TOTAL_DOUBLES)
def _(t):
    return rp.top_scores(scored(t, day_rows(t, names=scc.NAMES))["scores"], 20)


@query(
    "n3_factor_contributions",
    f"SELECT * FROM deco WHERE trade_date = DATE '{DAY}' AND entity IN (SELECT entity FROM sday WHERE rank <= 20)",
    ["deco", "sday"],
    doubles="raw_factor_value normalized_score factor_weight weighted_contribution",
)
def _(t):
    frames = scored(t, day_rows(t, names=scc.NAMES))
    return rp.contributions(frames["decorated"], rp.top_scores(frames["scores"], 20))


@query(
    "n4_gate_summary",
    """SELECT validation_status, count(*) AS factor_count, string_agg(factor_name, '; ' ORDER BY score_role, score_group, factor_name) AS factors,
              array_to_string(list_transform(list_sort(list(DISTINCT p)), lambda x: x[4:]), '; ') AS reasons
       FROM (SELECT *, min(lpad(CAST(k AS VARCHAR), 3, '0')) OVER (PARTITION BY validation_status, reason) || reason AS p
             FROM (SELECT *, row_number() OVER (ORDER BY score_role, score_group, factor_name) AS k FROM gate)) GROUP BY 1""",
    ["gate"],
)
def _(t):
    return rp.gate_summary(scc.gate(t))


@query(
    "n5_rank_changes",
    """SELECT * FROM (SELECT coalesce(a.entity, b.entity) AS entity, a.rank AS current_rank, b.rank AS compare_rank, b.rank - a.rank AS rank_delta,
              CASE WHEN b.rank IS NULL THEN 'added' WHEN a.rank IS NULL THEN 'removed' WHEN a.rank <> b.rank THEN 'rank_changed' END AS change_type,
              'candidates' AS current_source, 'candidates_before' AS compare_source,
              CASE WHEN b.rank IS NULL THEN '新增进入显式对比口径。' WHEN a.rank IS NULL THEN '从显式对比口径移出。'
                   WHEN b.rank > a.rank THEN '排名上升 ' || (b.rank - a.rank) || ' 位。' ELSE '排名下降 ' || (a.rank - b.rank) || ' 位。' END AS message
       FROM cday a FULL OUTER JOIN cprev b ON a.entity = b.entity) WHERE change_type IS NOT NULL""",
    ["cday", "cprev"],
)
def _(t):
    now, then = candidates(t, day_rows(t, names=sel.NAMES)), candidates(t, day_rows(t, BEFORE, sel.NAMES), BEFORE)
    return rp.rank_changes(now, then, current_source="candidates", compare_source="candidates_before")


@query("n6_risk_evidence", "SELECT * FROM nevid", ["nevid"])
def _(t):
    rows = day_rows(t)
    frames = scored(t, rows)
    return rp.risk_evidence(frames["exclusions"], frames["scores"], ann(t), risk(t), candidates(t, rows), DAY)


@query("n7_recent_announcements", "SELECT * FROM nann", ["nann"])
def _(t):
    return ann(t)


@query("n8_recent_risk_events", "SELECT * FROM nrisk", ["nrisk"])
def _(t):
    return risk(t)


@query(
    "n9_watchlist_summary",
    """SELECT w.entity, c.entity IS NOT NULL AS in_candidate_top_n, c.rank AS candidate_rank, c.selection_reason AS candidate_reason,
              s.entity IS NOT NULL AS in_score_top_n, s.rank AS score_rank, s.total_score, coalesce(e.n, 0) AS risk_tip_count,
              e.latest AS latest_evidence_date, coalesce(e.types, '') AS evidence_types
       FROM watch w LEFT JOIN cday c ON c.entity = w.entity LEFT JOIN (SELECT * FROM sday WHERE rank <= 20) s ON s.entity = w.entity
       LEFT JOIN (SELECT entity, count(*) AS n, max(evidence_date) AS latest, array_to_string(list_sort(list(DISTINCT evidence_type)), '; ') AS types
                  FROM nevid GROUP BY 1) e ON e.entity = w.entity""",
    ["watch", "cday", "sday", "nevid"],
    doubles="total_score",
)
def _(t):
    rows = day_rows(t)
    frames = scored(t, rows)
    cands = materialize(candidates(t, rows))
    evidence = rp.risk_evidence(frames["exclusions"], frames["scores"], ann(t), risk(t), cands, DAY)
    return rp.watchlist_summary(watch(t), cands, rp.top_scores(frames["scores"], 20), evidence)


def ic_summary(t):
    return va.ic_summary(vac.ic(t))


@query(
    "n10_validation_summary",
    "SELECT factor_name, horizon, valid_oriented_ic_dates, mean_oriented_rank_ic, oriented_icir FROM icsum",
    ["icsum"],
    doubles="mean_oriented_rank_ic oriented_icir",
    longs="horizon",
)
def _(t):
    return rp.validation_summary(ic_summary(t), ic_summary(t))


@query("n10_gate_fallback", "SELECT factor_name, validation_status, reason FROM gate", ["gate"])
def _(t):
    return rp.validation_summary(None, scc.gate(t))


_METRICS = [c for c in pfc._M.split() if c != "cost_drag"]


@query(
    "n11_metrics_long",
    " UNION ALL ".join(f"SELECT '{c}' AS metric, {pfc.slog(f'CAST({c} AS DOUBLE)')} AS value FROM kmetrics" for c in _METRICS),
    ["kmetrics"],
    doubles="value",
)
def _(t):
    wide = pfc.metrics(t).selectExpr(*[f"{pfc.slog(c)} AS {c}" for c in _METRICS])
    return rp.metrics_long(wide)


@query(
    "n11_event_summary",
    "SELECT event_source, event_type, horizon, sample_count, mean_excess_return, excess_win_rate FROM evsum",
    ["evsum"],
    doubles="mean_excess_return excess_win_rate",
    longs="horizon",
)
def _(t):
    return ev.summarize(evc.excess(t)).select(
        "event_source", "event_type", "horizon", "sample_count", "mean_excess_return", "excess_win_rate"
    )


_ALL_DAY = " UNION ALL ".join(f"SELECT * FROM f_{n} WHERE trade_date = DATE '{DAY}'" for n in NAMES)
cte("nfac", _ALL_DAY, [f"f_{n}" for n in NAMES])


@query(
    "n12_watchlist_factors",
    "SELECT * FROM nfac WHERE entity IN (SELECT entity FROM watch)",
    ["nfac", "watch"],
    doubles="factor_value",
)
def _(t):
    return rp.factor_listing(day_rows(t), watch(t))


_MOMENTUM = [n for n, spec in FACTORS.items() if spec[2] == "momentum"]


@query(
    "n12_momentum_history",
    f"SELECT * FROM ({' UNION ALL '.join(f'SELECT * FROM f_{n}' for n in _MOMENTUM)}) WHERE entity IN (SELECT entity FROM watch)",
    ["watch", *[f"f_{n}" for n in _MOMENTUM]],
    doubles="factor_value",
)
def _(t):
    return rp.factor_listing(factor_rows(t, _MOMENTUM), watch(t), "momentum")


@query(
    "n13_score_details",
    f"""SELECT * FROM (SELECT 'group' AS detail_type, entity, score_group, '' AS factor_name, CAST(NULL AS DOUBLE) AS raw_factor_value, CAST(NULL AS DOUBLE) AS normalized_score,
               group_score * group_weight AS weighted_contribution, group_score, missing AS missing_factor_count, '' AS validation_status FROM grouped WHERE trade_date = DATE '{DAY}'
        UNION ALL SELECT 'group', entity, 'event', '', NULL, NULL, 0.0, NULL, 0, '' FROM passed WHERE trade_date = DATE '{DAY}'
        UNION ALL SELECT 'factor', entity, score_group, factor_name, raw_factor_value, normalized_score, weighted_contribution, NULL, NULL, validation_status
          FROM deco WHERE trade_date = DATE '{DAY}') WHERE entity IN (SELECT entity FROM watch)""",
    ["grouped", "passed", "deco", "watch"],
    doubles="raw_factor_value normalized_score weighted_contribution group_score",
    longs="missing_factor_count",
)
def _(t):
    frames = scored(t, day_rows(t, names=scc.NAMES))
    return rp.score_details(sc.breakdown(frames["grouped"]), frames["decorated"], watch(t))


@query(
    "n14_entity_announcements",
    f"""SELECT announcement_id, entity, title, announcement_type, publish_time, effective_date,
               CASE WHEN announcement_id % 9 <> 0 THEN 'Summary ' || CAST(announcement_id AS VARCHAR) ELSE '' END AS summary,
               CASE WHEN announcement_id % 9 <> 0 AND announcement_id % 17 <> 0 AND (announcement_id % 3 = 0 OR announcement_id % 8 = 0) THEN 'item' ELSE '' END AS evidence_text,
               CASE WHEN announcement_id % 9 <> 0 THEN 0.5 + (announcement_id % 50) / 100.0 END AS confidence
        FROM announcements WHERE publish_time <= DATE '{DAY}' AND effective_date BETWEEN DATE '{DAY}' - 90 AND DATE '{DAY}'
          AND entity IN (SELECT entity FROM watch)""",
    ["announcements", "watch"],
    doubles="confidence",
)
def _(t):
    return rp.entity_announcements(t.announcements, t.parsed_results, watch(t), DAY, 90)


_FILTER_LIST = ", ".join(f"('{n}')" for n in HARD_FILTERS)


@query(
    "n15_entity_risk_flags",
    f"""SELECT 'hard_filter' AS source_type, w.entity, DATE '{DAY}' AS evidence_date, f.n AS evidence_type, 'blocking' AS severity,
               CASE WHEN v.factor_value IS NULL THEN 'missing_hard_filter' ELSE 'failed_hard_filter value=' || CAST(v.factor_value AS VARCHAR) END AS summary, '' AS evidence_id
        FROM watch w CROSS JOIN (VALUES {_FILTER_LIST}) f(n) LEFT JOIN nfac v ON v.entity = w.entity AND v.factor_name = f.n
        WHERE v.factor_value IS NULL OR v.factor_value <> 0
        UNION ALL SELECT * FROM ({_TIPS} UNION ALL {_X.format('score_hard_filter_exclusion')} UNION ALL SELECT * FROM nann UNION ALL SELECT * FROM nrisk)
          WHERE entity IN (SELECT entity FROM watch)""",
    ["watch", "nfac", "sday", "xday", "nann", "nrisk"],
)
def _(t):
    rows = day_rows(t, names=scc.NAMES)
    frames = scored(t, rows)
    return rp.entity_risk_flags(rows, frames["exclusions"], frames["scores"], ann(t), risk(t), watch(t), DAY)


@query(
    "n16_presence_review",
    f"""SELECT w.entity, x.name, i.industry_l1, i.industry_l2, m.entity IS NOT NULL AS in_target_universe,
               CASE WHEN c.rank IS NULL THEN 'not_in_candidate_pool' ELSE 'in_candidate_pool' END AS candidate_status, c.rank AS candidate_rank,
               CASE WHEN s.rank IS NULL THEN 'not_in_scored_top_n' ELSE 'in_scored_top_n' END AS score_status, s.rank AS score_rank, s.total_score,
               (SELECT count(*) FROM kt WHERE kt.entity = w.entity) AS target_weight_rows, (SELECT count(*) FROM kd WHERE kd.entity = w.entity) AS holding_rows,
               (SELECT count(*) FROM ev WHERE ev.entity = w.entity) AS matching_event_samples
        FROM watch w LEFT JOIN cday c ON c.entity = w.entity LEFT JOIN (SELECT * FROM sday WHERE rank <= 20) s ON s.entity = w.entity
        LEFT JOIN securities x ON x.entity = w.entity LEFT JOIN (SELECT * FROM ind_on WHERE trade_date = DATE '{DAY}') i ON i.entity = w.entity
        LEFT JOIN (SELECT entity FROM universe_all WHERE trade_date = DATE '{DAY}') m ON m.entity = w.entity""",
    ["watch", "cday", "sday", "securities", "ind_on", "universe_all", "kt", "kd", "ev"],
    doubles="total_score",
)
def _(t):
    rows = day_rows(t)
    frames = scored(t, rows)
    targets = pfc.targets(t)
    return rp.presence_review(
        watch(t), candidates(t, rows), rp.top_scores(frames["scores"], 20), targets, pf.holdings(targets, t.calendar, pfc.executable(t)), evc.events(t),
        asof.securities_as_of(t.securities, DAY, include_delisted=True), asof.intervals_as_of(t.industries, DAY),
        asof.members_as_of(t.members, DAY, "X"),
    )


@query(
    "n17_category_counts",
    """SELECT 'validation_status' AS category, validation_status AS value, count(*) AS row_count FROM gate GROUP BY 2
       UNION ALL SELECT 'hard_filter_name', hard_filter_name, count(*) FROM xday GROUP BY 2""",
    ["gate", "xday"],
)
def _(t):
    uni = asof.members_as_of(t.members, DAY, "X").selectExpr("entity", f"DATE'{DAY}' AS trade_date").distinct()
    dropped = sc.hard_filter_exclusions(day_rows(t, names=HARD_FILTERS), uni)
    gates = rp.category_counts(scc.gate(t), "validation_status", "validation_status")
    return gates.unionByName(rp.category_counts(dropped, "hard_filter_name", "hard_filter_name"))


@query(
    "n18_factor_slice",
    """SELECT 'coverage' AS frame, CAST(trade_date AS VARCHAR) AS day, CAST(NULL AS BIGINT) AS horizon, coverage AS value FROM cover WHERE factor_name = 'return_20d'
       UNION ALL SELECT 'rank_ic', CAST(trade_date AS VARCHAR), horizon, rank_ic FROM ic WHERE factor_name = 'return_20d'
       UNION ALL SELECT 'ic_summary', '', horizon, mean_rank_ic FROM icsum WHERE factor_name = 'return_20d'""",
    ["cover", "ic", "icsum"],
    doubles="value",
)
def _(t):
    rows = va.rank_ic(vac.labelled(t, ["return_20d"]), VALIDATION["min_ic_observations"])
    frames = [("coverage", vac.coverage(t, ["return_20d"])), ("rank_ic", rows), ("ic_summary", va.ic_summary(rows))]
    return rp.factor_slice(frames, "return_20d")
