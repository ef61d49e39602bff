"""M: text rules, announcement ingest and extraction checks."""

from __future__ import annotations

import uuid

from tidemark.catalog.registry import cte, query
from tidemark.functions.columns import normalize_text
from tidemark.operators import extraction as ex
from tidemark.session import materialize, shared_dir
from tidemark.sources import snapshots, upserts

# Titles of the derived announcements: real keywords in varying case, and texts without one.
WORDS = [
    "Share Repurchase Plan", "关于股份减持计划的公告", "Annual Report Summary 1999", "LAWSUIT notice", "Routine update",
    "业绩预告公告", "Material Contract signed", "Modified Audit opinion", "收到监管问询函", "行政处罚决定书", "dividend notice",
]
PROVIDER = ["earnings report", "其他", "buyback", "non-standard audit"]


def _array(values):
    return ", ".join(f"'{v}'" for v in values)


_TITLE = f"element_at(array({_array(WORDS)}), CAST(announcement_id % {len(WORDS)} AS INT) + 1)"
_RAW = f"CASE WHEN announcement_id % 3 = 0 THEN element_at(array({_array(PROVIDER)}), CAST(announcement_id % {len(PROVIDER)} AS INT) + 1) END"


def titled(t):
    return t.announcements.selectExpr(
        "announcement_id", "entity", "publish_time", "effective_date", "source_tag", f"{_TITLE} AS title", f"{_RAW} AS raw_type"
    )


cte(
    "titled",
    f"""SELECT announcement_id, entity, publish_time, effective_date, source_tag,
               [{_array(WORDS)}][announcement_id % {len(WORDS)} + 1] AS title,
               CASE WHEN announcement_id % 3 = 0 THEN [{_array(PROVIDER)}][announcement_id % {len(PROVIDER)} + 1] END AS raw_type
        FROM announcements""",
    ["announcements"],
)
_RULES = ", ".join(f"({i}, {j}, '{k}', '{w}')" for i, (k, ws) in enumerate(ex.RULES) for j, w in enumerate(ws))
cte(
    "classed",
    f"""SELECT t.*, coalesce(m.kind, 'other') AS announcement_type, coalesce(m.kind || '_keyword', 'default_other') AS rule_name,
               coalesce(m.word, '') AS matched_text,
               CASE WHEN m.kind IS NULL THEN 'no whitelist rule matched' ELSE m.src || ' matched ' || m.kind || '_keyword' END AS reason,
               m.kind IS NOT NULL AS selected
        FROM titled t LEFT JOIN (
          SELECT x.title, x.raw_type, r.kind, r.word, c.src
          FROM (SELECT DISTINCT title, raw_type FROM titled) x
          CROSS JOIN (VALUES (0, 'provider_type'), (1, 'title')) c(pos, src)
          JOIN (VALUES {_RULES}) r(i, j, kind, word)
            ON contains(lower(CASE WHEN c.pos = 0 THEN x.raw_type ELSE x.title END), lower(r.word))
          QUALIFY row_number() OVER (PARTITION BY x.title, x.raw_type ORDER BY r.i, c.pos, r.j) = 1) m
        ON m.title = t.title AND m.raw_type IS NOT DISTINCT FROM t.raw_type""",
    ["titled"],
)


@query("m1_classified_announcements", "SELECT * FROM classed", ["classed"])
def _(t):
    return ex.classify(titled(t), "raw_type", "title")


def incoming(t):
    """Announcements with bodies: inline text for even ids, stored text otherwise."""
    docs = t.raw("documents").selectExpr("doc_id AS announcement_id", "text")
    base = titled(t).join(docs, "announcement_id", "left")
    return base.selectExpr(
        "CAST(NULL AS STRING) AS given_id", "coalesce(source_tag, '') AS source_tag", "entity", "publish_time", "title",
        "CAST(NULL AS STRING) AS url", "raw_type", "CASE WHEN announcement_id % 2 = 0 THEN text END AS body_text",
        "CASE WHEN announcement_id % 7 <> 0 THEN text END AS stored_text",
    )


@query(
    "m2_prepared_announcements",
    """SELECT sha1(coalesce(source_tag, '') || '|' || CAST(entity AS VARCHAR) || '|' || CAST(publish_time AS VARCHAR) || '|' || lower(title) || '||' || coalesce(h, '')) AS announcement_id,
              entity, announcement_type, selected, publish_time, effective_date, body_source, h AS text_hash
       FROM (SELECT c.*, CASE WHEN n.normalized <> '' AND (c.announcement_id % 2 = 0 OR c.announcement_id % 7 <> 0) THEN sha256(n.normalized) END AS h,
                    CASE WHEN trim(d.text) <> '' AND c.announcement_id % 2 = 0 THEN 'text' WHEN d.text IS NOT NULL AND c.announcement_id % 7 <> 0 THEN 'stored'
                         ELSE 'missing' END AS body_source
             FROM classed c LEFT JOIN documents d ON d.doc_id = c.announcement_id LEFT JOIN normdoc n ON n.doc_id = c.announcement_id)""",
    ["classed", "normdoc"],
)
def _(t):
    return ex.prepare(incoming(t), t.calendar)


def stores(t):
    rows = t.announcements.selectExpr(
        "source_tag", "announcement_id", "entity", "sha2(title, 256) AS text_hash"
    )
    existing = rows.filter("announcement_id % 3 = 0").selectExpr(
        "source_tag", "announcement_id", "entity", "CASE WHEN announcement_id % 15 = 0 THEN 'old' ELSE text_hash END AS text_hash"
    )
    return existing, rows


@query(
    "m3_upsert_status",
    """SELECT CASE WHEN announcement_id % 3 <> 0 THEN 'inserted' WHEN announcement_id % 15 = 0 THEN 'conflict' ELSE 'skipped' END AS status,
              count(*) AS row_count FROM announcements GROUP BY 1""",
    ["announcements"],
)
def _(t):
    return ex.upsert_status(*stores(t), overwrite=False).groupBy("status").count().withColumnRenamed("count", "row_count")


@query(
    "m3_upserted_table",
    "SELECT source_tag, announcement_id, entity, sha256(title) AS text_hash FROM announcements",
    ["announcements"],
)
def _(t):
    return ex.upsert(*stores(t), overwrite=True)


@query(
    "m3_stored_upsert",
    "SELECT source_tag, announcement_id, entity, sha256(title) AS text_hash FROM announcements",
    ["announcements"],
)
def _(t):
    """The same upsert into a bucketed table, in batches of which one is delivered twice."""
    existing, rows = stores(t)
    path = f"{shared_dir(t.spark)}/announcements-{uuid.uuid4().hex}"
    key = ["source_tag", "announcement_id"]
    upserts.upsert_at(existing, path, key, "text_hash", stream="old", batch=0)
    halves = [rows.filter(f"pmod(announcement_id, 2) = {i}") for i in range(2)]
    for batch, half in [(0, halves[0]), (1, halves[1]), (0, halves[0])]:
        upserts.upsert_at(half, path, key, "text_hash", overwrite=True, stream="new", batch=batch)
    return snapshots.read(t.spark, path, rows.schema)


_WINDOW = ("1997-01-01", "2000-12-31", "1999-06-07")


@query(
    "m4_announcements_to_parse",
    f"""SELECT * FROM classed WHERE selected AND effective_date BETWEEN DATE '{_WINDOW[0]}' AND DATE '{_WINDOW[1]}'
        AND publish_time <= DATE '{_WINDOW[2]}' AND effective_date <= DATE '{_WINDOW[2]}'
        ORDER BY effective_date, publish_time, source_tag NULLS LAST, announcement_id LIMIT 50""",
    ["classed"],
)
def _(t):
    return ex.to_parse(ex.classify(titled(t), "raw_type", "title"), *_WINDOW, limit=50)


# ---- extraction responses of the documents ---------------------------------
# One response per document: excerpts of its own text as evidence, and by
# doc_id % 8 one of the faults a response can have.
_ITEMS = {
    "key_evidence": (
        "length(b) >= 95",
        "named_struct('summary', 's', 'evidence_text', substring(b, CAST(1 + doc_id % 50 AS INT), 40), 'page', 1)",
    ),
    "catalysts": (
        "doc_id % 2 = 0 AND length(b) >= 95",
        "named_struct('type', 't', 'summary', 's', 'evidence_text', concat(' ', substring(b, 11, 30), '  '), 'page', CAST(NULL AS INT))",
    ),
    "risks": ("doc_id % 3 = 0", "named_struct('type', 't', 'summary', 's', 'evidence_text', 'zz not there zz', 'page', 2)"),
    "extracted_metrics": (
        "true",
        "named_struct('metric_name', 'm', 'value', doc_id % 1000, 'evidence_text', CASE WHEN doc_id % 5 = 0 THEN concat('total ', doc_id % 1000) ELSE 'nothing' END, "
        "'raw_value_text', CASE WHEN doc_id % 7 = 0 THEN '' END)",
    ),
}


# JSON text of a fault and the error it gives.
FAULTS = [
    ('"note":"x"', "unexpected_field"),
    ('"risks":"abc"', "risks.list"),
    ('"risks":null', "risks.list"),
    ('"risks":[1]', "risks.item"),
    ('"key_evidence":[{"summary":5,"evidence_text":"e"}]', "key_evidence.item"),
    ('"key_evidence":[{"summary":"s","evidence_text":"e","page":"x"}]', "key_evidence.item"),
    ('"extracted_metrics":[{"metric_name":"m","value":[1],"evidence_text":"e"}]', "extracted_metrics.item"),
    ('"extracted_metrics":[{"metric_name":"m","value":1,"evidence_text":"e","raw_value_text":3}]', "extracted_metrics.item"),
    ('"записка":1', "unexpected_field"),
    ('"my-score":1', "unexpected_field"),
    ('"risks":[{"type":"t","summary":"s","evidence_text":"e","deep":{"SCORE":1}}]', "forbidden_field"),
]


def responses(t):
    lists = ", ".join(
        f"'{name}', filter(array({item}), x -> {rule})" for name, (rule, item) in _ITEMS.items()
    )
    head = (
        f"'schema_version', '{ex.SCHEMA_VERSION}', 'announcement_type', element_at(array('buyback', 'material_contract', 'earnings_report'), CAST(doc_id % 3 AS INT) + 1), "
        "'sentiment', CASE WHEN doc_id % 8 = 4 THEN 'bullish' ELSE 'neutral' END, "
        "'summary', CASE WHEN doc_id % 8 = 2 THEN '' ELSE 'summary' END"
    )
    plain = f"to_json(named_struct({head}, {lists}))"
    nested = f"to_json(named_struct({head}, {lists}, 'meta', named_struct('list', array(named_struct('Score', 1)))))"
    # Faults that a typed parser hides: appended to the plain head as JSON text.
    faults = " ".join(f"WHEN {i} THEN ',{json}}}'" for i, (json, _) in enumerate(FAULTS))
    start = f"to_json(named_struct({head}))"
    extra = f"concat(substring({start}, 1, length({start}) - 1), CASE doc_id div 8 % {len(FAULTS)} {faults} END)"
    docs = normalize_text(t.raw("documents").select("doc_id", "text"), "text", "b")
    return docs.selectExpr(
        "doc_id",
        "CASE WHEN doc_id % 8 = 5 THEN NULL ELSE b END AS body",
        "CASE WHEN doc_id % 6 = 0 THEN 'buyback' ELSE element_at(array('buyback', 'material_contract', 'other'), CAST(doc_id % 3 AS INT) + 1) END AS rule_type",
        "concat('run-', doc_id % 4) AS parse_run_id",
        f"CASE doc_id % 8 WHEN 1 THEN substring({plain}, 1, 20) WHEN 3 THEN {nested} WHEN 6 THEN {extra} WHEN 7 THEN NULL ELSE {plain} END AS response",
    )


def validated(t):
    return ex.validate_responses(responses(t))


_FAULT_ERRORS = " ".join(f"WHEN {i} THEN '{error}'" for i, (_, error) in enumerate(FAULTS))
cte(
    "resp",
    f"""SELECT doc_id, b AS body, 'run-' || CAST(doc_id % 4 AS VARCHAR) AS parse_run_id,
              CASE WHEN doc_id % 8 = 5 OR b = '' THEN 'missing_body' WHEN doc_id % 8 = 7 THEN 'llm_error' WHEN doc_id % 8 = 0 THEN 'success' ELSE 'schema_invalid' END AS status,
              CASE WHEN doc_id % 8 = 5 OR b = '' THEN 'body_missing' WHEN doc_id % 8 = 7 THEN 'no_response' WHEN doc_id % 8 = 1 THEN 'invalid_json'
                   WHEN doc_id % 8 = 2 THEN 'summary' WHEN doc_id % 8 = 3 THEN 'forbidden_field' WHEN doc_id % 8 = 4 THEN 'sentiment'
                   WHEN doc_id % 8 = 6 THEN CASE (doc_id // 8) % {len(FAULTS)} {_FAULT_ERRORS} END END AS error
       FROM (SELECT doc_id, normalized AS b FROM normdoc)""",
    ["normdoc"],
)
cte(
    "refs",
    """SELECT doc_id, body, 'key_evidence' AS item_type, 0 AS item_index, substr(body, 1 + doc_id % 50, 40) AS evidence_text, 1 AS page
         FROM resp WHERE status = 'success' AND length(body) >= 95
       UNION ALL SELECT doc_id, body, 'catalysts', 0, ' ' || substr(body, 11, 30) || '  ', NULL FROM resp WHERE status = 'success' AND doc_id % 2 = 0 AND length(body) >= 95
       UNION ALL SELECT doc_id, body, 'risks', 0, 'zz not there zz', 2 FROM resp WHERE status = 'success' AND doc_id % 3 = 0
       UNION ALL SELECT doc_id, body, 'extracted_metrics', 0, CASE WHEN doc_id % 5 = 0 THEN 'total ' || CAST(doc_id % 1000 AS VARCHAR) ELSE 'nothing' END, NULL
         FROM resp WHERE status = 'success'""",
    ["resp"],
)
cte(
    "loc",
    """SELECT doc_id, item_type, item_index, evidence_text, page, st AS locator_status,
              CASE st WHEN 'exact' THEN instr(body, evidence_text) - 1 WHEN 'normalized' THEN instr(body, nv) - 1 END AS char_start,
              CASE st WHEN 'exact' THEN instr(body, evidence_text) - 1 + length(evidence_text) WHEN 'normalized' THEN instr(body, nv) - 1 + length(nv) END AS char_end
       FROM (SELECT *, CASE WHEN instr(body, evidence_text) > 0 THEN 'exact' WHEN instr(body, nv) > 0 THEN 'normalized' ELSE 'not_found' END AS st
             FROM (SELECT *, trim(regexp_replace(evidence_text, '\\s+', ' ', 'g')) AS nv FROM refs))""",
    ["refs"],
)


@query("m5_response_status", "SELECT doc_id, status, error FROM resp", ["resp"])
def _(t):
    return validated(t).select("doc_id", "status", "error")


def references(t):
    return ex.evidence_references(validated(t).filter("status = 'success'"), "doc_id", ["body"])


@query(
    "m6_evidence_references",
    "SELECT doc_id, item_type, item_index, evidence_text, page FROM refs",
    ["refs"],
    longs="item_index page",
)
def _(t):
    return references(t).drop("body")


@query("m7_located_evidence", "SELECT * FROM loc", ["loc"], longs="item_index page char_start char_end")
def _(t):
    return ex.locate(references(t), "body").drop("body")


@query(
    "m8_confidence",
    """SELECT doc_id, total_items, items_with_evidence, located_count, total_metrics, matched_metrics,
              0.25 + 0.15 + 0.20 * items_with_evidence / total_items + 0.25 * located_count / items_with_evidence
                + 0.10 * CASE WHEN ok THEN 1 ELSE 0 END + 0.05 * matched_metrics / total_metrics AS confidence,
              concat_ws('; ', CASE WHEN located_count < items_with_evidence THEN 'evidence not located' END, CASE WHEN NOT ok THEN 'type differs from rule' END,
                        CASE WHEN matched_metrics < total_metrics THEN 'metrics not found' END) AS warnings
       FROM (SELECT r.doc_id, l.n AS total_items, l.n AS items_with_evidence, l.located AS located_count, 1 AS total_metrics,
                    CASE WHEN r.doc_id % 5 = 0 OR contains(r.body, CAST(r.doc_id % 1000 AS VARCHAR)) THEN 1 WHEN contains('nothing', CAST(r.doc_id % 1000 AS VARCHAR)) THEN 1 ELSE 0 END AS matched_metrics,
                    CASE WHEN r.doc_id % 3 = 2 THEN FALSE ELSE TRUE END AS ok
             FROM resp r JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE locator_status IN ('exact', 'normalized')) AS located FROM loc GROUP BY 1) l
               ON l.doc_id = r.doc_id WHERE r.status = 'success')""",
    ["resp", "loc"],
    doubles="confidence",
    longs="total_metrics matched_metrics",
)
def _(t):
    valid = materialize(validated(t).filter("status = 'success'"))
    located = ex.locate(ex.evidence_references(valid, "doc_id", ["body"]), "body")
    return ex.confidence(valid, located, "doc_id", "body")


@query(
    "m9_parse_run_summary",
    """SELECT parse_run_id, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS success,
              count(*) FILTER (WHERE status = 'schema_invalid') AS schema_invalid, count(*) FILTER (WHERE status = 'missing_body') AS missing_body,
              count(*) FILTER (WHERE status = 'llm_error') AS llm_error,
              CASE WHEN count(*) FILTER (WHERE status <> 'success') = 0 THEN 'success' ELSE 'partial_failed' END AS run_status
       FROM resp GROUP BY 1""",
    ["resp"],
)
def _(t):
    return ex.parse_summary(validated(t))
