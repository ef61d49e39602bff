"""Gated composite scores for all signal dates at once, and their diagnostics."""

from __future__ import annotations

import copy
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranks import SLICE_ROWS, correlation, largest_group, row_numbers, value_positions, with_average_rank
from tidemark.params import FACTORS, HARD_FILTERS, SCORING, VALIDATION_GATE, config_rows
from tidemark.session import materialize

KEY = ["entity", "trade_date"]


def clamp(x: str, lo: float, hi: float) -> str:
    """SQL: bounded value; NULL stays NULL (least and greatest alone would drop it)."""
    return f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, {float(lo)}D), {float(hi)}D) END"


def score_inputs(store: DataFrame, universe: DataFrame, names: Sequence[str]) -> DataFrame:
    return (
        store.filter("as_of_date = trade_date")
        .filter(F.col("factor_name").isin(list(names)))
        .join(universe, KEY, "left_semi")
    )


def hard_filter_exclusions(store: DataFrame, universe: DataFrame, filters: Sequence[str] = HARD_FILTERS) -> DataFrame:
    """One row per failed or missing (entity, date, filter)."""
    listed = ", ".join(f"'{n}'" for n in filters)
    grid = universe.selectExpr(*KEY, f"explode(array({listed})) AS hard_filter_name")
    values = store.selectExpr(*KEY, "factor_name AS hard_filter_name", "factor_value")
    return (
        grid.join(values, [*KEY, "hard_filter_name"], "left")
        .filter("factor_value IS NULL OR factor_value <> 0")
        .selectExpr(
            "*",
            "CASE WHEN factor_value IS NULL THEN 'missing_hard_filter' ELSE 'failed_hard_filter' END AS exclusion_reason",
        )
    )


def passed(store: DataFrame, universe: DataFrame) -> DataFrame:
    """Universe rows with every filter present and zero, in one aggregation."""
    ok = (
        store.filter(F.col("factor_name").isin(HARD_FILTERS))
        .filter("factor_value = 0")
        .groupBy(*KEY)
        .agg(F.expr("count(DISTINCT factor_name) AS n"))
        .filter(f"n = {len(HARD_FILTERS)}")
    )
    return universe.join(ok, KEY, "left_semi")


def normalized_scores(rows: DataFrame, scoring: dict = SCORING, largest: int | None = None) -> DataFrame:
    """0-100 percentile scores per (date, factor) after orientation; ``largest`` bounds the entities of a date."""
    flipped = [
        n for n, spec in FACTORS.items() if spec[1] == "lower_is_better" and n not in scoring["risk"]["factors"]
    ]
    sign = f"CASE WHEN factor_name IN ({', '.join(repr(n) for n in flipped)}) THEN -1 ELSE 1 END"
    oriented = rows.filter("factor_value IS NOT NULL").selectExpr(
        *KEY, "factor_name", "factor_value AS raw_factor_value", f"factor_value * {sign} AS oriented"
    )
    group = ["trade_date", "factor_name"]
    score = (
        f"CASE WHEN _total = 1 THEN {scoring['single_observation_score']}D "
        f"WHEN _count = _total THEN {scoring['all_equal_score']}D "
        "ELSE 100 * (_before + (_count + 1) / 2 - 1) / (_total - 1) END"
    )
    if largest is not None and largest <= SLICE_ROWS:
        # Groups that fit one slice: their rows are shuffled once and meet no table of values.
        g = ", ".join(group)
        placed = oriented.selectExpr(
            "*", f"rank() OVER (PARTITION BY {g} ORDER BY oriented) - 1L AS _before", f"count(*) OVER (PARTITION BY {g}, oriented) AS _count",
            f"count(*) OVER (PARTITION BY {g}) AS _total",
        )
        return placed.selectExpr(*KEY, "factor_name", "raw_factor_value", f"{clamp(score, 0, 100)} AS normalized_score")
    scores = value_positions(oriented, group, "oriented", largest=largest).selectExpr(
        *group, "oriented", f"{clamp(score, 0, 100)} AS normalized_score"
    )
    return oriented.join(scores, [*group, "oriented"]).select(
        *KEY, "factor_name", "raw_factor_value", "normalized_score"
    )


def decorate(normalized: DataFrame, scoring: dict = SCORING) -> DataFrame:
    config = normalized.sparkSession.createDataFrame(
        config_rows(scoring), "factor_name STRING, score_role STRING, score_group STRING, factor_weight DOUBLE"
    )
    return normalized.join(config, "factor_name").selectExpr(
        "*", "normalized_score * factor_weight AS weighted_contribution", "'PASS' AS validation_status"
    )


def wide_scores(normalized: DataFrame, universe: DataFrame, scoring: dict = SCORING) -> DataFrame:
    """One row per passed entity and date with a column per configured factor."""
    names = [name for name, _, _, _ in config_rows(scoring)]
    cells = [F.expr(f"max(CASE WHEN factor_name = '{n}' THEN normalized_score END) AS {n}") for n in names]
    return universe.select(*KEY).join(normalized.groupBy(*KEY).agg(*cells), KEY, "left")


def _weighted(weights: dict[str, float]) -> tuple[str, str]:
    """SQL for available weight and weighted score sum over the present factors."""
    avail = " + ".join(f"CASE WHEN {n} IS NOT NULL THEN {w!r}D ELSE 0.0D END" for n, w in weights.items())
    total = " + ".join(f"coalesce({n} * {w!r}D, 0.0D)" for n, w in weights.items())
    return f"({avail})", f"({total})"


def _enabled(scoring: dict) -> dict[str, dict]:
    return {g: spec for g, spec in scoring["groups"].items() if spec["enabled"]}


def group_scores(wide: DataFrame, scoring: dict = SCORING) -> DataFrame:
    """Adds ``<group>_avail``, ``<group>_missing`` and ``<group>_score`` columns."""
    floor = scoring["min_available_factor_weight"]
    cols = []
    for group, spec in _enabled(scoring).items():
        avail, total = _weighted(spec["factors"])
        missing = " + ".join(f"CAST({n} IS NULL AS INT)" for n in spec["factors"])
        score = f"CASE WHEN {avail} >= {floor}D AND {avail} > 0 THEN {total} / {avail} END"
        cols += [
            f"{avail} AS {group}_avail", f"{missing} AS {group}_missing", f"{clamp(f'({score})', 0, 100)} AS {group}_score"
        ]
    return wide.selectExpr("*", *cols)


def breakdown(grouped: DataFrame, scoring: dict = SCORING) -> DataFrame:
    """Long group rows, disabled groups included."""
    rows = []
    for group, spec in scoring["groups"].items():
        w, required = float(spec["weight"]) if spec["enabled"] else 0.0, str(spec["required"]).lower()
        if spec["enabled"]:
            cells = (
                f"true, {required}, {w!r}D, {group}_score, {group}_score * {w!r}D, {group}_avail, "
                f"CAST({group}_missing AS BIGINT)"
            )
        else:
            cells = f"false, {required}, {w!r}D, CAST(NULL AS DOUBLE), 0.0D, 0.0D, 0L"
        rows.append(f"'{group}', {cells}")
    names = (
        "score_group, group_enabled, group_required, group_weight, group_score, weighted_contribution, "
        "available_factor_weight, missing_factor_count"
    )
    return grouped.selectExpr(*KEY, f"stack({len(rows)}, {', '.join(rows)}) AS ({names})")


def positive_score_sql(scoring: dict) -> str:
    weights = {f"{g}_score": spec["weight"] for g, spec in _enabled(scoring).items()}
    avail, total = _weighted(weights)
    return f"CASE WHEN {avail} > 0 THEN {total} / {avail} END"


def risk_penalty_sql(scoring: dict) -> str:
    avail, total = _weighted(scoring["risk"]["factors"])
    cap, floor = scoring["risk"]["max_penalty"], scoring["min_available_factor_weight"]
    return (
        f"CASE WHEN {avail} >= {floor}D AND {avail} > 0 "
        f"THEN least({cap}D, {total} / {avail} / 100 * {cap}D) ELSE 0.0D END"
    )


def totals(grouped: DataFrame, scoring: dict = SCORING) -> DataFrame:
    """Positive score, penalty and total; rows without a usable group drop out."""
    required = [f"{g}_score IS NOT NULL" for g, spec in _enabled(scoring).items() if spec["required"]]
    out = grouped.selectExpr(
        "*", f"{positive_score_sql(scoring)} AS positive", f"{risk_penalty_sql(scoring)} AS risk_penalty"
    ).filter(" AND ".join(["positive IS NOT NULL", *required]))
    groups = [f"{g}_score" for g in _enabled(scoring)]
    return out.selectExpr(
        *KEY, *groups, f"{clamp('positive', 0, 100)} AS positive_score", "risk_penalty",
        f"{clamp('(positive - risk_penalty)', 0, 100)} AS total_score",
    )


def score_exclusions(grouped: DataFrame, scoring: dict = SCORING) -> DataFrame:
    """Entities dropped for a missing required group, or for having no group at all."""
    required = [f"{g}_score IS NULL" for g, spec in _enabled(scoring).items() if spec["required"]] or ["false"]
    reason = (
        f"CASE WHEN {' OR '.join(required)} THEN 'required_group_unavailable' "
        f"WHEN {positive_score_sql(scoring)} IS NULL THEN 'no_group_available' END"
    )
    return grouped.selectExpr(*KEY, f"{reason} AS reason").filter("reason IS NOT NULL")


def ranked(
    scores: DataFrame, groups: Sequence[str] = ("trade_date",), largest: int | None = None
) -> DataFrame:
    """Rank by total descending, then entity, exactly and without one task per large date."""
    keyed = scores.selectExpr("*", "-total_score AS _key")
    return row_numbers(keyed, list(groups), ["_key", "entity"], "rank", "_n", largest=largest).drop("_key", "_n")


def composite(store: DataFrame, universe: DataFrame, eligible: Sequence[str] | None = None, scoring: dict = SCORING) -> dict:
    """Normalised, grouped and total scores of a factor store."""
    names = [n for n, _, _, _ in config_rows(scoring) if eligible is None or n in eligible]
    kept = passed(store, universe)
    inputs = score_inputs(store, kept, names)
    normalized = normalized_scores(inputs, scoring)
    grouped = group_scores(wide_scores(normalized, kept, scoring), scoring)
    return {"passed": kept, "normalized": normalized, "grouped": grouped, "totals": totals(grouped, scoring)}


# Texts of the score report.
def score_reason() -> str:
    return (
        "format_string('综合评分排名第 %d；total_score=%.4f；硬过滤均通过；仅通过验证门槛的因子进入评分。', rank, total_score)"
    )


NO_PENALTY_TEXT = "未触发本阶段软风险扣分"


def score_tips() -> str:
    return (
        "CASE WHEN risk_penalty > 0 THEN format_string('软风险扣分 %.4f 分', risk_penalty) "
        f"ELSE '{NO_PENALTY_TEXT}' END"
    )


# ---- gate ---------------------------------------------------------------


def validation_gate(
    coverage: DataFrame,
    ic_summary: DataFrame,
    groups: DataFrame,
    scoring: dict = SCORING,
    gate: dict = VALIDATION_GATE,
    filters: Sequence[str] = HARD_FILTERS,
) -> DataFrame:
    """PASS, FAIL or SKIP per configured factor with ordered reasons.

    The inputs are validation summaries: a few rows per factor.
    """
    spark = coverage.sparkSession
    items, roles = [], {}
    for group, spec in scoring["groups"].items():
        off = spec.get("disabled_factors", ())
        items += [(n, "positive", group, spec["enabled"] and n not in off) for n in spec["factors"]]
    items += [(n, "risk_penalty", "risk", True) for n in scoring["risk"]["factors"]]
    rows = []
    for name, role, group, enabled in items:
        clash = enabled and name in roles and roles[name] != role
        if enabled:
            roles[name] = role
        kind, direction = (FACTORS[name][0], FACTORS[name][1]) if name in FACTORS else (None, None)
        rows.append((name, role, group, enabled, clash, kind, direction, name in filters))
    config = spark.createDataFrame(
        rows,
        "factor_name STRING, score_role STRING, score_group STRING, configured_enabled BOOLEAN, clash BOOLEAN, "
        "kind STRING, direction STRING, is_filter BOOLEAN",
    )
    cov = coverage.groupBy("factor_name").agg(F.expr("avg(coverage) AS coverage"))
    horizons = gate["required_horizons"]
    wanted = ", ".join(str(h) for h in horizons)
    ic = ic_summary.filter(f"horizon IN ({wanted})").groupBy("factor_name").agg(
        F.expr("min(valid_oriented_ic_dates) AS valid_oriented_ic_dates"),
        F.expr("min(mean_oriented_rank_ic) AS mean_oriented_rank_ic"),
        F.expr("min(oriented_icir) AS oriented_icir"),
        *[
            F.expr(f"max(CASE WHEN horizon = {h} THEN {c} END) AS {c}_{h}")
            for h in horizons
            for c in ("valid_oriented_ic_dates", "mean_oriented_rank_ic", "oriented_icir")
        ],
        *[F.expr(f"count_if(horizon = {h}) AS found_{h}") for h in horizons],
    )
    per_group = groups.filter(f"horizon IN ({wanted})").groupBy("factor_name").agg(
        F.expr("count(*) AS group_return_rows"),
        *[F.expr(f"count_if(horizon = {h}) AS groups_{h}") for h in horizons],
    )
    reasons = [
        ("clash", "'factor used in multiple score roles'"),
        ("kind IS NULL", "'factor missing from data dictionary'"),
        ("kind = 'hard_filter'", "'hard_filter factors cannot be scored'"),
        ("is_filter", "'factor is configured as a hard filter'"),
        ("kind IS NOT NULL AND coalesce(direction, '') = ''", "'missing direction'"),
        ("coverage IS NULL", "'factor missing from coverage.csv'"),
        (
            f"coverage < {gate['min_coverage']}D",
            f"concat('coverage ', CAST(round(coverage, 6) AS STRING), ' below minimum {gate['min_coverage']:.6g}')",
        ),
    ]
    for h in horizons:
        found = f"coalesce(found_{h}, 0) > 0"
        reasons += [
            (f"NOT ({found})", f"'missing ic_summary horizon {h}'"),
            (
                f"{found} AND coalesce(valid_oriented_ic_dates_{h}, -1) < {gate['min_valid_oriented_ic_dates']}",
                f"'horizon {h} valid_oriented_ic_dates below minimum'",
            ),
            (
                f"{found} AND (mean_oriented_rank_ic_{h} IS NULL OR mean_oriented_rank_ic_{h} < {gate['min_mean_oriented_rank_ic']}D)",
                f"'horizon {h} mean_oriented_rank_ic below minimum'",
            ),
        ]
        if gate["min_oriented_icir"] > -999.0:
            reasons.append((f"{found} AND oriented_icir_{h} IS NULL", f"'horizon {h} oriented_icir is missing'"))
        reasons.append(
            (f"{found} AND oriented_icir_{h} < {gate['min_oriented_icir']}D", f"'horizon {h} oriented_icir below minimum'")
        )
        if gate["require_group_return_rows"]:
            reasons.append((f"{found} AND coalesce(groups_{h}, 0) = 0", f"'horizon {h} missing group_returns rows'"))
    ordered = ", ".join(f"CASE WHEN {rule} THEN {text} END" for rule, text in reasons)
    return (
        config.join(cov, "factor_name", "left")
        .join(ic, "factor_name", "left")
        .join(per_group, "factor_name", "left")
        .selectExpr("*", f"array_distinct(array_compact(array({ordered}))) AS parts")
        .selectExpr(
            "factor_name", "score_role", "score_group", "configured_enabled",
            "CASE WHEN NOT configured_enabled THEN 'SKIP' WHEN size(parts) > 0 THEN 'FAIL' ELSE 'PASS' END AS validation_status",
            "CASE WHEN NOT configured_enabled THEN 'configured disabled' WHEN size(parts) > 0 THEN array_join(parts, '; ') "
            "ELSE 'passed' END AS reason",
            f"'{','.join(str(h) for h in horizons)}' AS required_horizons",
            "coverage", "valid_oriented_ic_dates", "mean_oriented_rank_ic", "oriented_icir",
            "coalesce(group_return_rows, 0) AS group_return_rows",
        )
    )


def eligible_factors(gate: DataFrame, strict: bool = False) -> DataFrame:
    """Enabled factors with their eligibility; strict mode fails the query on any miss."""
    out = gate.filter("configured_enabled").selectExpr(
        "factor_name", "score_role", "validation_status = 'PASS' AS eligible",
        "CASE WHEN validation_status <> 'PASS' THEN concat('Skipping factor that did not pass validation gate: ', factor_name) END AS warning",
    )
    if strict:
        out = out.withColumn(
            "eligible",
            F.expr(
                "CASE WHEN eligible THEN true ELSE CAST(raise_error(concat('gate failed for ', factor_name)) AS BOOLEAN) END"
            ),
        )
    return out


# ---- diagnostics --------------------------------------------------------


def scenarios(scoring: dict = SCORING) -> list[dict]:
    """Every enabled group and factor weight moved up and down, the others rescaled."""
    step = scoring["perturbation"]
    out = []

    def moved(weights: dict[str, float], name: str, direction: str) -> tuple[dict[str, float], str]:
        others = {k: w for k, w in weights.items() if k != name and w > 0}
        new = weights[name] * (1 + step if direction == "up" else 1 - step)
        if not others:
            return dict(weights), name
        rest = max(0.0, 1.0 - new)
        scale = sum(others.values())
        return {k: new if k == name else (w / scale * rest if k in others else w) for k, w in weights.items()}, ""

    groups = {g: spec["weight"] for g, spec in _enabled(scoring).items() if spec["weight"] > 0}
    for group in groups:
        for direction in ("up", "down"):
            config = copy.deepcopy(scoring)
            weights, fixed = moved(groups, group, direction)
            for g, w in weights.items():
                config["groups"][g]["weight"] = w
            warning = "No other enabled group weight can be renormalized." if fixed else ""
            out.append(_scenario(f"groups.{group}.weight", "group_weight", direction, config, warning))
    for group in groups:
        factors = scoring["groups"][group]["factors"]
        for name in factors:
            for direction in ("up", "down"):
                config = copy.deepcopy(scoring)
                config["groups"][group]["factors"], fixed = moved(factors, name, direction)
                warning = "No other enabled factor weight can be renormalized." if fixed else ""
                key = f"groups.{group}.factors.{name}.weight"
                out.append(_scenario(key, "factor_weight", direction, config, warning))
    return out


def _scenario(key: str, kind: str, direction: str, config: dict, warning: str) -> dict:
    return {
        "name": f"{key}.{direction}", "type": kind, "key": key, "direction": direction, "config": config,
        "warning": warning,
    }


def scenario_totals(wide: DataFrame, scoring: dict = SCORING) -> DataFrame:
    """Total score under every scenario: one output row per scenario and entity.

    The scenarios travel as a literal array of weights, so every row fans out to
    a fixed number of rows and one expression serves them all.
    """
    cases = [("baseline", scoring)] + [(s["name"], s["config"]) for s in scenarios(scoring)]
    groups = list(_enabled(scoring))
    factors = [n for g in groups for n in scoring["groups"][g]["factors"]]
    structs = []
    for name, config in cases:
        gw = [f"{config['groups'][g]['weight']!r}D AS g_{g}" for g in groups]
        fw = [f"{w!r}D AS f_{n}" for g in groups for n, w in config["groups"][g]["factors"].items()]
        structs.append(f"struct('{name}' AS name, {', '.join(gw + fw)})")
    fanned = wide.selectExpr(
        *KEY, *factors, f"({risk_penalty_sql(scoring)}) AS _penalty", f"explode(array({', '.join(structs)})) AS s"
    )
    floor = scoring["min_available_factor_weight"]
    sums = []
    for g in groups:
        names = list(scoring["groups"][g]["factors"])
        avail = " + ".join(f"CASE WHEN {n} IS NOT NULL THEN s.f_{n} ELSE 0.0D END" for n in names)
        total = " + ".join(f"coalesce({n} * s.f_{n}, 0.0D)" for n in names)
        sums += [f"{avail} AS {g}_a", f"{total} AS {g}_t"]
    scores = [
        clamp(f"(CASE WHEN {g}_a >= {floor}D AND {g}_a > 0 THEN {g}_t / {g}_a END)", 0, 100) + f" AS {g}_s" for g in groups
    ]
    avail = " + ".join(f"CASE WHEN {g}_s IS NOT NULL THEN s.g_{g} ELSE 0.0D END" for g in groups)
    total = " + ".join(f"coalesce({g}_s * s.g_{g}, 0.0D)" for g in groups)
    return (
        fanned.selectExpr(*KEY, "_penalty", "s", *sums)
        .selectExpr(*KEY, "_penalty", "s", *scores)
        .selectExpr(*KEY, "_penalty", "s.name AS scenario_name", f"{avail} AS _a", f"{total} AS _t")
        .filter("_a > 0")
        .selectExpr(*KEY, "scenario_name", f"{clamp('(_t / _a - _penalty)', 0, 100)} AS total_score")
    )


def weight_sensitivity(totals_by_scenario: DataFrame, top_n: int, scoring: dict = SCORING) -> DataFrame:
    """Rank correlation, top-N overlap and score change of each scenario per date."""
    keys = ["scenario_name", "trade_date"]
    placed = materialize(ranked(totals_by_scenario, keys))
    base = placed.filter("scenario_name = 'baseline'").selectExpr(*KEY, "rank AS base_rank", "total_score AS base_score")
    base_n = base.groupBy("trade_date").agg(F.expr("count(*) AS baseline_candidate_count"))
    other = placed.filter("scenario_name <> 'baseline'")
    other_n = other.groupBy(*keys).agg(F.expr("count(*) AS scenario_candidate_count"))
    joined = materialize(other.join(base, KEY).selectExpr(
        *keys, "entity", "rank AS scen_rank", "total_score AS scen_score", "base_rank", "base_score"
    ))
    # Ranks inside the joined set: unique keys, so a row number is the average rank.
    largest = largest_group(joined, keys)
    joined = row_numbers(joined, keys, ["scen_rank"], "_x", "_n", largest=largest).drop("_n")
    joined = row_numbers(joined, keys, ["base_rank"], "_y", "_n", largest=largest).drop("_n")
    stats = joined.groupBy(*keys).agg(
        F.expr(correlation("_x", "_y") + " AS spearman_rank_corr"),
        F.expr(f"count_if(scen_rank <= {top_n} AND base_rank <= {top_n}) AS top_n_overlap_count"),
        F.expr("CAST(max(abs(base_rank - scen_rank)) AS DOUBLE) AS max_abs_rank_change"),
        F.expr("avg(abs(base_score - scen_score)) AS mean_abs_score_change"),
        F.expr("count(*) AS common_count"),
    )
    described = totals_by_scenario.sparkSession.createDataFrame(
        [(s["name"], s["type"], s["key"], s["direction"], s["warning"]) for s in scenarios(scoring)],
        "scenario_name STRING, scenario_type STRING, changed_key STRING, change_direction STRING, warning STRING",
    )
    return (
        other_n.join(base_n, "trade_date")
        .join(stats, keys, "left")
        .join(described, "scenario_name")
        .selectExpr(
            *keys, "scenario_type", "changed_key", "change_direction", f"{scoring['perturbation']}D AS change_pct",
            f"CAST({top_n} AS BIGINT) AS top_n", "baseline_candidate_count", "scenario_candidate_count",
            "CASE WHEN common_count >= 2 THEN spearman_rank_corr END AS spearman_rank_corr",
            "coalesce(top_n_overlap_count, 0) AS top_n_overlap_count",
            f"try_divide(coalesce(top_n_overlap_count, 0), least({top_n}, baseline_candidate_count)) AS top_n_overlap_ratio",
            "CASE WHEN common_count >= 2 THEN max_abs_rank_change END AS max_abs_rank_change",
            "CASE WHEN common_count >= 2 THEN mean_abs_score_change END AS mean_abs_score_change",
            "concat_ws('; ', nullif(warning, ''), CASE WHEN coalesce(common_count, 0) < 2 THEN "
            "'Candidate count below 2; rank correlation is NaN.' END) AS warning",
        )
    )


def yearly_score_stability(
    scores: DataFrame, labels: DataFrame, signals: DataFrame, horizons: Sequence[int], min_dates: int = 1
) -> DataFrame:
    """Yearly rank IC and tail spread of the total score."""
    cross = ["trade_date", "horizon"]
    merged = materialize(scores.select(*KEY, "total_score").join(labels, KEY))
    largest = largest_group(merged, cross)
    x = with_average_rank(merged, cross, "total_score", "_x", largest=largest)
    x = with_average_rank(x, cross, "forward_return", "_y", largest=largest)
    ics = x.groupBy(*cross).agg(
        F.expr("count(*) AS n"), F.expr(f"CASE WHEN count(*) >= 2 THEN {correlation('_x', '_y')} END AS ic")
    )
    placed = row_numbers(merged, cross, ["total_score", "entity"], "_rn", "_n", largest=largest)
    tail = "greatest(1, _n div 5)"
    spreads = placed.filter("_n >= 2").groupBy(*cross).agg(
        F.expr(f"avg(CASE WHEN _rn > _n - {tail} THEN forward_return END) - avg(CASE WHEN _rn <= {tail} THEN forward_return END) AS spread")
    )
    by_year = (
        ics.join(spreads, cross, "left")
        .groupBy(F.expr("year(trade_date) AS year"), "horizon")
        .agg(
            F.expr("count(*) AS signal_date_count"),
            F.expr("sum(n) AS stock_observation_count"),
            F.expr("avg(ic) AS rank_ic_mean"),
            F.expr("CASE WHEN count(ic) > 1 THEN stddev_samp(ic) END AS rank_ic_std"),
            F.expr("CASE WHEN count(ic) > 1 THEN try_divide(avg(ic), stddev_samp(ic)) END AS rank_icir"),
            F.expr("avg(spread) AS top_bottom_spread_mean"),
            F.expr("avg(CAST(ic > 0 AS INT)) AS positive_rank_ic_rate"),
        )
    )
    listed = ", ".join(f"{h}L" for h in horizons)
    grid = signals.selectExpr("year(trade_date) AS year").distinct().selectExpr("year", f"explode(array({listed})) AS horizon")
    return (
        grid.join(by_year, ["year", "horizon"], "left")
        .withColumns(
            {c: F.expr(f"coalesce({c}, 0)") for c in ("signal_date_count", "stock_observation_count")}
        )
        .selectExpr(
            "*",
            f"CASE WHEN signal_date_count >= {min_dates} THEN 'ok' ELSE 'insufficient' END AS status",
            f"CASE WHEN signal_date_count < {min_dates} THEN concat('signal_date_count ', signal_date_count, ' below minimum {min_dates}') "
            "ELSE '' END AS warning",
        )
    )
