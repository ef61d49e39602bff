"""Text classification, announcement ingest and checks of extraction responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import normalize_text, stable_id, text_hash
from tidemark.functions.calendar import next_open

# Canonical types in rule order with their keywords.
RULES: list[tuple[str, list[str]]] = [
    (
        "earnings_forecast",
        ["earnings_forecast", "业绩预告", "盈利预告", "业绩预增", "业绩预减", "预盈", "预亏", "earnings forecast", "performance forecast"],
    ),
    (
        "earnings_report",
        [
            "earnings_report", "业绩快报", "定期报告摘要", "年报摘要", "半年报摘要", "一季报摘要", "三季报摘要", "年度报告摘要",
            "半年度报告摘要", "季度报告摘要", "earnings report", "annual report summary", "quarterly report summary",
            "periodic report summary",
        ],
    ),
    ("buyback", ["buyback", "repurchase", "股份回购", "回购股份", "回购公司股份", "回购方案"]),
    (
        "shareholder_reduce",
        ["shareholder_reduce", "减持", "减持计划", "股份减持", "股东减持", "shareholding reduction", "shareholder reduction"],
    ),
    ("inquiry_letter", ["inquiry_letter", "问询函", "监管问询", "交易所问询", "inquiry letter"]),
    ("regulatory_penalty", ["regulatory_penalty", "行政处罚", "监管处罚", "处罚决定", "regulatory penalty"]),
    ("material_contract", ["material_contract", "重大合同", "重要合同", "material contract", "significant contract"]),
    ("material_litigation", ["material_litigation", "重大诉讼", "重大仲裁", "诉讼", "仲裁", "litigation", "lawsuit"]),
    (
        "non_standard_audit",
        [
            "non_standard_audit", "非标准审计", "非标审计", "非标准无保留意见", "保留意见", "无法表示意见", "否定意见",
            "qualified opinion", "modified audit", "non-standard audit",
        ],
    ),
]
TYPES = [name for name, _ in RULES]

# Response schema.
SCHEMA_VERSION = "phase2.v1"
SENTIMENTS = ["positive", "neutral", "negative", "mixed", "unknown"]
FORBIDDEN_KEYS = ["score", "total_score", "target_price", "buy", "sell", "recommendation", "confidence"]
TOP_KEYS = [
    "schema_version", "announcement_type", "sentiment", "summary", "key_evidence", "catalysts", "risks", "extracted_metrics",
]
ITEM_KEYS = {
    "key_evidence": ["summary", "evidence_text", "page"],
    "catalysts": ["type", "summary", "evidence_text", "page"],
    "risks": ["type", "summary", "evidence_text", "page"],
    "extracted_metrics": ["metric_name", "value", "evidence_text", "page", "raw_value_text"],
}
ITEM_REQUIRED = {
    "key_evidence": ["summary", "evidence_text"],
    "catalysts": ["type", "summary", "evidence_text"],
    "risks": ["type", "summary", "evidence_text"],
    "extracted_metrics": ["metric_name", "evidence_text"],
}
RESPONSE_SCHEMA = (
    "schema_version STRING, announcement_type STRING, sentiment STRING, summary STRING, "
    "key_evidence ARRAY<STRUCT<summary: STRING, evidence_text: STRING, page: INT>>, "
    "catalysts ARRAY<STRUCT<type: STRING, summary: STRING, evidence_text: STRING, page: INT>>, "
    "risks ARRAY<STRUCT<type: STRING, summary: STRING, evidence_text: STRING, page: INT>>, "
    "extracted_metrics ARRAY<STRUCT<metric_name: STRING, value: STRING, evidence_text: STRING, page: INT, raw_value_text: STRING>>"
)

# Confidence weights.
CONFIDENCE_WEIGHTS = {
    "schema_valid": 0.25,
    "required_fields_complete": 0.15,
    "evidence_present": 0.20,
    "evidence_located_in_text": 0.25,
    "announcement_type_whitelisted_and_consistent": 0.10,
    "numeric_metrics_match_text": 0.05,
}


def _quoted(values: Sequence[str]) -> str:
    return ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)


def classify(df: DataFrame, provider: str, title: str, whitelist: Sequence[str] = TYPES) -> DataFrame:
    """Add type, rule, matched text, reason and selection of the first matching rule.

    Rules go first, then provider type before title, then keywords in order.
    """
    norm = normalize_text(normalize_text(df, provider, "_p"), title, "_t").selectExpr(
        *df.columns, "lower(_p) AS _p", "lower(_t) AS _t"
    )

    # One small number per row decides everything else: 2 * rule + source.
    branches, lists = [], []
    for i, (_, words) in enumerate(RULES):
        pattern = "|".join(w.lower() for w in words)
        branches += [f"WHEN _p RLIKE '{pattern}' THEN {2 * i}", f"WHEN _t RLIKE '{pattern}' THEN {2 * i + 1}"]
        lists.append(f"array({_quoted(words)})")
    found = norm.selectExpr("*", f"CASE {' '.join(branches)} ELSE -1 END AS _i")
    wanted = f"element_at(array({_quoted(TYPES)}), CAST(_i div 2 + 1 AS INT))"
    text = "CASE WHEN _i % 2 = 0 THEN _p ELSE _t END"
    word = f"element_at(filter(element_at(array({', '.join(lists)}), CAST(_i div 2 + 1 AS INT)), w -> contains({text}, lower(w))), 1)"
    source = "CASE WHEN _i % 2 = 0 THEN 'provider_type' ELSE 'title' END"
    return found.selectExpr(
        *df.columns,
        f"CASE WHEN _i < 0 THEN 'other' ELSE {wanted} END AS announcement_type",
        f"CASE WHEN _i < 0 THEN 'default_other' ELSE concat({wanted}, '_keyword') END AS rule_name",
        f"CASE WHEN _i < 0 THEN '' ELSE {word} END AS matched_text",
        f"CASE WHEN _i < 0 THEN 'no whitelist rule matched' ELSE concat({source}, ' matched ', {wanted}, '_keyword') END AS reason",
        f"CASE WHEN _i < 0 THEN false ELSE {wanted} IN ({_quoted(list(whitelist) or ['-'])}) END AS selected",
    )


def prepare(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """Body precedence (inline text over stored text), hash, id, type and effective date.

    ``rows`` has source_tag, entity, publish_time, title, url, raw_type,
    body_text, stored_text and an optional announcement_id.
    """
    with_body = rows.selectExpr(
        "*",
        "coalesce(nullif(trim(body_text), ''), stored_text) AS _body",
        "CASE WHEN nullif(trim(body_text), '') IS NOT NULL THEN 'text' WHEN stored_text IS NOT NULL THEN 'stored' ELSE 'missing' END AS body_source",
    )
    hashed = normalize_text(with_body, "_body", "_normalized").selectExpr(
        *with_body.columns, f"CASE WHEN _normalized <> '' THEN {text_hash('_normalized')} END AS text_hash"
    )
    new_id = stable_id("source_tag", "entity", "publish_time", "lower(title)", "lower(url)", "text_hash")
    named = hashed.selectExpr(*rows.columns, "body_source", "text_hash", f"coalesce(given_id, {new_id}) AS announcement_id")
    typed = classify(named, "raw_type", "title")
    return next_open(typed, "publish_time", calendar, "effective_date").select(
        "announcement_id", "entity", "announcement_type", "selected", "publish_time", "effective_date", "body_source", "text_hash"
    )


def upsert_status(existing: DataFrame, incoming: DataFrame, overwrite: bool) -> DataFrame:
    """Per incoming row: inserted, skipped (same hash), overwritten or conflict."""
    old = existing.selectExpr("source_tag AS _tag", "announcement_id AS _id", "text_hash AS _old", "true AS _known")
    changed = "'overwritten'" if overwrite else "CASE WHEN _old <=> text_hash THEN 'skipped' ELSE 'conflict' END"
    return incoming.join(old, F.expr("source_tag <=> _tag AND announcement_id = _id"), "left").selectExpr(
        *incoming.columns, f"CASE WHEN _known IS NULL THEN 'inserted' ELSE {changed} END AS status"
    )


def upsert(existing: DataFrame, incoming: DataFrame, overwrite: bool) -> DataFrame:
    """The table after the upsert.  A conflict fails it; see :func:`upsert_status` for all of them."""
    status = upsert_status(existing, incoming, overwrite).withColumn(
        "status", F.expr("CASE WHEN status = 'conflict' THEN CAST(raise_error('announcement exists with another text') AS STRING) ELSE status END")
    )
    new = status.filter("status IN ('inserted', 'overwritten')").drop("status")
    gone = new.selectExpr("source_tag AS _tag", "announcement_id AS _id")
    kept = existing.join(gone, F.expr("source_tag <=> _tag AND announcement_id = _id"), "left_anti")
    return kept.unionByName(new.select(*existing.columns))


def to_parse(classified: DataFrame, start: str, end: str, as_of: str | None, limit: int | None = None) -> DataFrame:
    """Selected announcements in an effective range, known on a date, in parse order."""
    rule = f"selected AND effective_date BETWEEN DATE'{start}' AND DATE'{end}'"
    if as_of:
        rule += f" AND to_date(publish_time) <= DATE'{as_of}' AND effective_date <= DATE'{as_of}'"
    out = classified.filter(rule)
    if limit is not None:
        out = out.orderBy(
            "effective_date", "publish_time", F.asc_nulls_last("source_tag"), "announcement_id"
        ).limit(limit)
    return out


def validate_responses(df: DataFrame, response: str = "response", body: str = "body") -> DataFrame:
    """Status and first error of each response.

    Types are read from the parsed VARIANT: lists must be lists of objects, texts strings, pages whole numbers from 1 (also
    written as text), values text or numbers.  Keys at any depth come from the JSON text that the VARIANT writes.
    """
    kind = "coalesce(schema_of_variant(try_variant_get({0}, '$.{1}', 'variant')), 'MISSING')"
    # String tokens of the canonical text; those that a colon follows are keys.
    tokens = r"""regexp_extract_all(to_json(_v), '"(?:[^"\\\\]|\\\\.)*+":?', 0)"""
    keys = f"transform(filter({tokens}, t -> endswith(t, ':')), t -> substring(t, 2, length(t) - 3))"
    parsed = df.selectExpr(
        "*", f"try_parse_json({response}) AS _v", f"from_json({response}, '{RESPONSE_SCHEMA}') AS _r",
    ).selectExpr(
        "*",
        f"coalesce({keys}, array()) AS _all",
        f"json_object_keys({response}) AS _top",
        *[f"try_variant_get(_v, '$.{name}', 'array<variant>') AS _l_{name}" for name in ITEM_KEYS],
    )
    checks = [
        (f"exists(_all, k -> lower(k) IN ({_quoted(FORBIDDEN_KEYS)}))", "forbidden_field"),
        (f"size(array_except(_top, array({_quoted(TOP_KEYS)}))) > 0", "unexpected_field"),
        (f"coalesce(_r.schema_version <> '{SCHEMA_VERSION}', true)", "schema_version"),
        (f"coalesce(_r.announcement_type NOT IN ({_quoted(TYPES)}), true)", "announcement_type"),
        (f"coalesce(_r.sentiment NOT IN ({_quoted(SENTIMENTS)}), true)", "sentiment"),
        (f"{kind.format('_v', 'summary')} <> 'STRING' OR coalesce(length(_r.summary), 0) = 0", "summary"),
    ]
    text = "try_variant_get(x, '$.{0}', 'string')"
    page_kind, page = kind.format("x", "page"), text.format("page")
    number = f"CASE WHEN {page_kind} = 'BOOLEAN' THEN CAST({page} = 'true' AS DOUBLE) ELSE try_cast(trim({page}) AS DOUBLE) END"
    bad_page = f"{page_kind} NOT IN ('MISSING', 'VOID') AND coalesce({number} < 1 OR {number} <> floor({number}), true)"
    for name, allowed in ITEM_KEYS.items():
        bad = ["NOT startswith(schema_of_variant(x), 'OBJECT<')", bad_page]
        for f in ITEM_REQUIRED[name]:
            bad.append(f"{kind.format('x', f)} <> 'STRING' OR coalesce(length({text.format(f)}), 0) = 0")
        if "value" in allowed:
            bad.append(f"NOT {kind.format('x', 'value')} RLIKE '^(STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|DECIMAL.*)$'")
            bad.append(f"{kind.format('x', 'raw_value_text')} NOT IN ('STRING', 'VOID', 'MISSING')")
        checks.append((f"array_contains(_top, '{name}') AND _l_{name} IS NULL", f"{name}.list"))
        unexpected = f"size(array_except(coalesce(json_object_keys(to_json(x)), array()), array({_quoted(allowed)}))) > 0"
        checks.append((f"coalesce(exists(_l_{name}, x -> {unexpected}), false)", f"{name}.unexpected_field"))
        checks.append((f"coalesce(exists(_l_{name}, x -> {' OR '.join(f'({rule})' for rule in bad)}), false)", f"{name}.item"))
    error = "CASE WHEN _v IS NULL OR _top IS NULL THEN 'invalid_json' " + " ".join(
        f"WHEN {rule} THEN '{label}'" for rule, label in checks
    ) + " END"
    return parsed.selectExpr(*df.columns, "_r AS parsed", f"{error} AS _error").selectExpr(
        *df.columns,
        "parsed",
        f"CASE WHEN coalesce(trim({body}), '') = '' THEN 'missing_body' WHEN {response} IS NULL THEN 'llm_error' "
        "WHEN _error IS NOT NULL THEN 'schema_invalid' ELSE 'success' END AS status",
        f"CASE WHEN coalesce(trim({body}), '') = '' THEN 'body_missing' WHEN {response} IS NULL THEN 'no_response' "
        "ELSE _error END AS error",
    )


def evidence_references(valid: DataFrame, key: str, carry: Sequence[str] = ()) -> DataFrame:
    """One row per evidence item with its list and position, in a single explode."""
    lists = ", ".join(
        f"transform(coalesce(parsed.{n}, array()), (x, i) -> named_struct('item_type', '{n}', 'item_index', i, "
        "'evidence_text', x.evidence_text, 'page', x.page))"
        for n in ITEM_KEYS
    )
    return valid.selectExpr(key, *carry, f"explode(flatten(array({lists}))) AS e").selectExpr(
        key, *carry, "e.item_type AS item_type", "CAST(e.item_index AS BIGINT) AS item_index",
        "e.evidence_text AS evidence_text", "CAST(e.page AS BIGINT) AS page",
    )


def locate(references: DataFrame, body: str) -> DataFrame:
    """Find evidence in its own normalised body: exact, normalised or not found."""
    n = normalize_text(references, "evidence_text", "_norm").selectExpr(
        *references.columns, "_norm", f"instr({body}, evidence_text) AS _e", f"instr({body}, _norm) AS _n"
    )
    status = (
        "CASE WHEN coalesce(evidence_text, '') = '' THEN 'missing' WHEN _e > 0 THEN 'exact' WHEN _n > 0 THEN 'normalized' ELSE 'not_found' END"
    )
    start = "CASE locator_status WHEN 'exact' THEN _e - 1 WHEN 'normalized' THEN _n - 1 END"
    length = "CASE locator_status WHEN 'exact' THEN length(evidence_text) WHEN 'normalized' THEN length(_norm) END"
    return n.selectExpr("*", f"{status} AS locator_status").selectExpr(
        *references.columns, "locator_status", f"CAST({start} AS BIGINT) AS char_start",
        f"CAST({start} + {length} AS BIGINT) AS char_end",
    )


def confidence(valid: DataFrame, located: DataFrame, key: str, body: str) -> DataFrame:
    """Weighted confidence of six components per response, with its counts."""
    found = located.groupBy(key).agg(
        F.expr("count_if(evidence_text <> '') AS items_with_evidence"),
        F.expr("count_if(locator_status IN ('exact', 'normalized')) AS located_count"),
    )
    total = " + ".join(f"size(coalesce(parsed.{n}, array()))" for n in ITEM_KEYS)
    metrics = valid.selectExpr(key, f"{body} AS _body", "explode(parsed.extracted_metrics) AS x").selectExpr(
        key, "_body", "coalesce(nullif(x.raw_value_text, ''), x.value) AS _value", "x.evidence_text AS _evidence"
    )
    metrics = normalize_text(normalize_text(metrics, "_value", "_candidate"), "_evidence", "_near")
    # A blank candidate matches nothing.
    hits = metrics.groupBy(key).agg(
        F.expr("count_if(_candidate <> '' AND (contains(_near, _candidate) OR contains(_body, _candidate))) AS matched")
    )
    filled = " + ".join(f"CAST(trim(coalesce(parsed.{f}, '')) <> '' AS INT)" for f in TOP_KEYS[:4])
    joined = valid.join(found, key, "left").join(hits, key, "left").selectExpr(
        key,
        f"{total} AS total_items",
        "coalesce(items_with_evidence, 0) AS items_with_evidence",
        "coalesce(located_count, 0) AS located_count",
        "size(coalesce(parsed.extracted_metrics, array())) AS total_metrics",
        "coalesce(matched, 0) AS matched_metrics",
        f"({filled}) / 4 AS required_score",
        f"parsed.announcement_type = rule_type AND rule_type IN ({_quoted(TYPES)}) AS type_consistent",
    )
    w = CONFIDENCE_WEIGHTS
    present = "CASE WHEN total_items = 0 THEN 1.0D ELSE items_with_evidence / total_items END"
    locate_score = (
        "CASE WHEN items_with_evidence = 0 THEN CASE WHEN total_items = 0 THEN 1.0D ELSE 0.0D END ELSE located_count / items_with_evidence END"
    )
    metric_score = "CASE WHEN total_metrics = 0 THEN 1.0D ELSE matched_metrics / total_metrics END"
    score = (
        f"{w['schema_valid']}D + {w['required_fields_complete']}D * required_score + {w['evidence_present']}D * ({present}) "
        f"+ {w['evidence_located_in_text']}D * ({locate_score}) "
        f"+ {w['announcement_type_whitelisted_and_consistent']}D * CAST(type_consistent AS INT) "
        f"+ {w['numeric_metrics_match_text']}D * ({metric_score})"
    )
    warnings = (
        "concat_ws('; ', CASE WHEN located_count < items_with_evidence THEN 'evidence not located' END, "
        "CASE WHEN NOT type_consistent THEN 'type differs from rule' END, "
        "CASE WHEN matched_metrics < total_metrics THEN 'metrics not found' END)"
    )
    counts = ("total_items", "items_with_evidence", "located_count", "total_metrics", "matched_metrics")
    return joined.selectExpr(
        key, *[f"CAST({c} AS BIGINT) AS {c}" for c in counts], f"round({score}, 6) AS confidence", f"{warnings} AS warnings"
    )


def parse_summary(validated: DataFrame) -> DataFrame:
    """Counts by status and the status of the whole run."""
    return validated.groupBy("parse_run_id").agg(
        F.expr("count(*) AS total"),
        *[F.expr(f"count_if(status = '{s}') AS {s}") for s in ("success", "schema_invalid", "missing_body", "llm_error")],
        F.expr("CASE WHEN count_if(status <> 'success') = 0 THEN 'success' ELSE 'partial_failed' END AS run_status"),
    )
