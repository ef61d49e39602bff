"""Evidence roll-ups and comparison tables of a report date, for many entities at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranks import first_per_key
from tidemark.operators.scoring import NO_PENALTY_TEXT
from tidemark.params import FACTORS, HARD_FILTERS

RISK_COLUMNS = ["source_type", "entity", "evidence_date", "evidence_type", "severity", "summary", "evidence_id"]


def candidates_with_scores(candidates: DataFrame, scores: DataFrame, top_n: int) -> DataFrame:
    part = scores.selectExpr("entity", "rank AS score_rank", "total_score", "risk_penalty", "true AS hard_filter_passed")
    base = candidates.select("rank", "entity", "name", "industry_l1", "industry_l2", "selection_reason", "risk_tips")
    return base.join(part, "entity", "left").orderBy("rank").limit(top_n)


def top_scores(scores: DataFrame, top_n: int) -> DataFrame:
    return scores.orderBy("rank").limit(top_n)


def contributions(decorated: DataFrame, reported: DataFrame) -> DataFrame:
    return decorated.join(reported.select("entity"), "entity", "left_semi")


def gate_summary(gate: DataFrame) -> DataFrame:
    """Factors and distinct reasons per status; the gate has one row per configured factor."""
    rows = "array_sort(collect_list(struct(score_role, score_group, factor_name, reason)))"
    return gate.groupBy("validation_status").agg(F.expr("count(*) AS factor_count"), F.expr(f"{rows} AS r")).selectExpr(
        "validation_status", "factor_count", "array_join(transform(r, x -> x.factor_name), '; ') AS factors",
        "array_join(array_distinct(transform(r, x -> x.reason)), '; ') AS reasons",
    )


def rank_changes(
    current: DataFrame, previous: DataFrame, limit: int | None = None, current_source: str = "current", compare_source: str = "previous"
) -> DataFrame:
    """Added, removed and moved entities between two ranked lists: all, or the first ``limit``."""
    a = current.selectExpr("entity", "rank AS current_rank")
    b = previous.selectExpr("entity", "rank AS compare_rank")
    kind = (
        "CASE WHEN compare_rank IS NULL THEN 'added' WHEN current_rank IS NULL THEN 'removed' "
        "WHEN current_rank <> compare_rank THEN 'rank_changed' END"
    )
    # The words of the messages.
    message = (
        "CASE WHEN change_type = 'added' THEN '新增进入显式对比口径。' WHEN change_type = 'removed' THEN '从显式对比口径移出。' "
        "WHEN rank_delta IS NULL THEN '排名发生变化。' "
        "ELSE concat('排名', CASE WHEN rank_delta > 0 THEN '上升' ELSE '下降' END, ' ', abs(rank_delta), ' 位。') END"
    )
    changes = (
        a.join(b, "entity", "full_outer")
        .selectExpr("*", f"{kind} AS change_type", "compare_rank - current_rank AS rank_delta")
        .filter("change_type IS NOT NULL")
        .selectExpr("*", f"'{current_source}' AS current_source", f"'{compare_source}' AS compare_source", f"{message} AS message")
    )
    if limit is None:
        return changes
    return changes.orderBy("change_type", F.asc_nulls_last("current_rank"), "entity").limit(limit)


def _recent(facts: DataFrame, day: str, days: int) -> DataFrame:
    return facts.filter(
        f"to_date(publish_time) <= DATE'{day}' AND effective_date BETWEEN date_sub(DATE'{day}', {days}) AND DATE'{day}'"
    )


def latest_results(results: DataFrame) -> DataFrame:
    """Newest successful extraction per announcement."""
    ok = results.filter("status = 'success'").select(
        "announcement_id", "created_at", "parse_id", "summary", "confidence", "parsed_json"
    )
    return first_per_key(ok, ["announcement_id"], ["created_at DESC", "parse_id"])


def recent_announcements(announcements: DataFrame, results: DataFrame, day: str, days: int) -> DataFrame:
    """Announcements of the last days; the newest summary stands in for the title."""
    latest = latest_results(results).selectExpr("announcement_id", "summary AS _summary")
    return _recent(announcements, day, days).join(latest, "announcement_id", "left").selectExpr(
        "'announcement' AS source_type", "entity", "effective_date AS evidence_date", "announcement_type AS evidence_type",
        "'info' AS severity", "coalesce(nullif(_summary, ''), title) AS summary", "CAST(announcement_id AS STRING) AS evidence_id",
    )


def recent_risk_events(events: DataFrame, day: str, days: int) -> DataFrame:
    return _recent(events, day, days).selectExpr(
        "'risk_event' AS source_type", "entity", "coalesce(effective_date, event_date) AS evidence_date",
        "event_type AS evidence_type", "'warning' AS severity", "concat('Risk event: ', event_type) AS summary",
        "CAST(event_id AS STRING) AS evidence_id",
    )


def exclusion_evidence(exclusions: DataFrame) -> DataFrame:
    return exclusions.selectExpr(
        "'hard_filter' AS source_type", "entity", "trade_date AS evidence_date", "hard_filter_name AS evidence_type",
        "'blocking' AS severity", "exclusion_reason AS summary", "'' AS evidence_id",
    )


def tip_evidence(scores: DataFrame, day: str) -> DataFrame:
    return scores.filter(F.col("risk_tips") != NO_PENALTY_TEXT).selectExpr(
        "'score_risk' AS source_type", "entity", f"DATE'{day}' AS evidence_date", "'risk_tips' AS evidence_type",
        "'warning' AS severity", "risk_tips AS summary", "'' AS evidence_id",
    )


def risk_evidence(
    exclusions: DataFrame, scores: DataFrame, announcements: DataFrame, events: DataFrame, entities: DataFrame, day: str
) -> DataFrame:
    """All risk evidence; facts are restricted to the reported entities."""
    facts = announcements.unionByName(events).join(entities.select("entity"), "entity", "left_semi")
    return (
        exclusion_evidence(exclusions)
        .unionByName(tip_evidence(scores, day))
        .unionByName(facts.select(*RISK_COLUMNS))
    )


def watchlist_summary(watch: DataFrame, candidates: DataFrame, scores: DataFrame, evidence: DataFrame) -> DataFrame:
    """Presence, ranks and evidence roll-up of each watched entity."""
    c = candidates.selectExpr("entity", "rank AS candidate_rank", "selection_reason AS candidate_reason", "true AS _c")
    s = scores.selectExpr("entity", "rank AS score_rank", "total_score", "true AS _s")
    # Evidence kinds are a short vocabulary, so the set stays small however much evidence there is.
    e = evidence.join(watch, "entity", "left_semi").groupBy("entity").agg(
        F.expr("count(*) AS risk_tip_count"),
        F.expr("max(evidence_date) AS latest_evidence_date"),
        F.expr("array_join(array_sort(collect_set(evidence_type)), '; ') AS evidence_types"),
    )
    return (
        watch.join(c, "entity", "left").join(s, "entity", "left").join(e, "entity", "left").selectExpr(
            "entity", "coalesce(_c, false) AS in_candidate_top_n", "candidate_rank", "candidate_reason",
            "coalesce(_s, false) AS in_score_top_n", "score_rank", "total_score", "coalesce(risk_tip_count, 0) AS risk_tip_count",
            "latest_evidence_date", "coalesce(evidence_types, '') AS evidence_types",
        )
    )


def validation_summary(ic_summary: DataFrame | None, gate: DataFrame) -> DataFrame:
    """IC figures when a validation run is given, else the gate's verdicts."""
    if ic_summary is not None:
        return ic_summary.select(
            "factor_name", "horizon", "valid_oriented_ic_dates", "mean_oriented_rank_ic", "oriented_icir"
        )
    return gate.select("factor_name", "validation_status", "reason")


def metrics_long(metrics: DataFrame) -> DataFrame:
    names = metrics.columns
    pairs = ", ".join(f"'{n}', CAST({n} AS DOUBLE)" for n in names)
    return metrics.selectExpr(f"stack({len(names)}, {pairs}) AS (metric, value)")


def factor_listing(store: DataFrame, entities: DataFrame, group: str | None = None) -> DataFrame:
    out = store.join(entities.select("entity"), "entity", "left_semi")
    if group is not None:
        out = out.filter(F.col("factor_name").isin([n for n, spec in FACTORS.items() if spec[2] == group]))
    return out


def score_details(breakdown: DataFrame, decorated: DataFrame, entities: DataFrame) -> DataFrame:
    """Group and factor rows of the same entities in one table."""
    groups = breakdown.selectExpr(
        "'group' AS detail_type", "entity", "score_group", "'' AS factor_name", "CAST(NULL AS DOUBLE) AS raw_factor_value",
        "CAST(NULL AS DOUBLE) AS normalized_score", "weighted_contribution", "group_score", "missing_factor_count",
        "'' AS validation_status",
    )
    factors = decorated.selectExpr(
        "'factor' AS detail_type", "entity", "score_group", "factor_name", "raw_factor_value", "normalized_score",
        "weighted_contribution", "CAST(NULL AS DOUBLE) AS group_score", "CAST(NULL AS BIGINT) AS missing_factor_count",
        "validation_status",
    )
    return groups.unionByName(factors).join(entities.select("entity"), "entity", "left_semi")


def entity_announcements(
    announcements: DataFrame, results: DataFrame, entities: DataFrame, day: str, days: int
) -> DataFrame:
    """Recent announcements with the newest summary, first evidence text and confidence."""
    latest = latest_results(results).selectExpr(
        "announcement_id", "summary",
        "coalesce(get_json_object(parsed_json, '$.risks[0]'), get_json_object(parsed_json, '$.catalysts[0]')) AS evidence_text",
        "confidence",
    )
    mine = _recent(announcements, day, days).join(entities.select("entity"), "entity", "left_semi")
    return mine.join(latest, "announcement_id", "left").selectExpr(
        "announcement_id", "entity", "title", "announcement_type", "publish_time", "effective_date",
        "coalesce(summary, '') AS summary", "coalesce(evidence_text, '') AS evidence_text", "confidence",
    )


def entity_risk_flags(
    store: DataFrame, exclusions: DataFrame, scores: DataFrame, announcements: DataFrame, events: DataFrame,
    entities: DataFrame, day: str,
) -> DataFrame:
    """Failed or missing filters, score tips, exclusions and recent facts per entity."""
    listed = ", ".join(f"'{n}'" for n in HARD_FILTERS)
    grid = entities.selectExpr("entity", f"explode(array({listed})) AS factor_name")
    values = store.select("entity", "factor_name", "factor_value")
    filters = (
        grid.join(values, ["entity", "factor_name"], "left")
        .filter("factor_value IS NULL OR factor_value <> 0")
        .selectExpr(
            "'hard_filter' AS source_type", "entity", f"DATE'{day}' AS evidence_date", "factor_name AS evidence_type",
            "'blocking' AS severity",
            "CASE WHEN factor_value IS NULL THEN 'missing_hard_filter' ELSE concat('failed_hard_filter value=', factor_value) END AS summary",
            "'' AS evidence_id",
        )
    )
    tips = scores.selectExpr(
        "'score_risk' AS source_type", "entity", f"DATE'{day}' AS evidence_date", "'risk_tips' AS evidence_type",
        "'warning' AS severity", "risk_tips AS summary", "'' AS evidence_id",
    )
    dropped = exclusion_evidence(exclusions).withColumn("source_type", F.lit("score_hard_filter_exclusion"))
    rest = tips.unionByName(dropped).unionByName(announcements).unionByName(events)
    return filters.unionByName(rest.join(entities.select("entity"), "entity", "left_semi"))


def presence_review(
    entities: DataFrame, candidates: DataFrame, scores: DataFrame, targets: DataFrame, holdings: DataFrame, samples: DataFrame,
    securities: DataFrame, industries: DataFrame, members: DataFrame,
) -> DataFrame:
    """Where each entity appears, with counts and what is known about it on the report date."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.join(entities, "entity", "left_semi").groupBy("entity").agg(F.expr(f"count(*) AS {name}"))

    out = entities.select("entity")
    for part in (
        candidates.selectExpr("entity", "rank AS candidate_rank"),
        scores.selectExpr("entity", "rank AS score_rank", "total_score"),
        counted(targets, "target_weight_rows"),
        counted(holdings, "holding_rows"),
        counted(samples, "matching_event_samples"),
        securities.select("entity", "name"),
        first_per_key(industries.select("entity", "in_date", "industry_l1", "industry_l2"), ["entity"], ["in_date"]).drop("in_date"),
        members.selectExpr("entity", "true AS _member").distinct(),
    ):
        out = out.join(part, "entity", "left")
    return out.selectExpr(
        "entity", "name", "industry_l1", "industry_l2", "coalesce(_member, false) AS in_target_universe",
        "CASE WHEN candidate_rank IS NULL THEN 'not_in_candidate_pool' ELSE 'in_candidate_pool' END AS candidate_status", "candidate_rank",
        "CASE WHEN score_rank IS NULL THEN 'not_in_scored_top_n' ELSE 'in_scored_top_n' END AS score_status", "score_rank", "total_score",
        "coalesce(target_weight_rows, 0) AS target_weight_rows", "coalesce(holding_rows, 0) AS holding_rows",
        "coalesce(matching_event_samples, 0) AS matching_event_samples",
    )


def category_counts(df: DataFrame, column: str, category: str) -> DataFrame:
    return df.groupBy(F.expr(f"{column} AS value")).agg(F.expr("count(*) AS row_count")).selectExpr(
        f"'{category}' AS category", "value", "row_count"
    )


def factor_slice(frames: Sequence[tuple[str, DataFrame]], factor: str) -> DataFrame:
    """Rows of one factor in several validation frames, as frame, key and value."""
    out = None
    for name, df in frames:
        value = "coverage" if name == "coverage" else ("rank_ic" if name == "rank_ic" else "mean_rank_ic")
        key = "CAST(trade_date AS STRING)" if "trade_date" in df.columns else "''"
        horizon = "horizon" if "horizon" in df.columns else "CAST(NULL AS BIGINT)"
        part = df.filter(F.col("factor_name") == factor).selectExpr(
            f"'{name}' AS frame", f"{key} AS day", f"{horizon} AS horizon", f"{value} AS value"
        )
        out = part if out is None else out.unionByName(part)
    return out
