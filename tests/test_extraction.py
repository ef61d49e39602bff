"""Response validation and metric matching."""

import json

import pytest

from tidemark.operators import extraction as ex

HEAD = {"schema_version": ex.SCHEMA_VERSION, "announcement_type": "buyback", "sentiment": "neutral", "summary": "s"}
METRIC = {"metric_name": "m", "value": "1", "evidence_text": "e"}
RISK = {"type": "t", "summary": "s", "evidence_text": "e"}
CASES = [
    ({}, None), ({"risks": []}, None), ({"risks": [RISK | {"page": None}]}, None), ({"risks": [RISK | {"page": 3}]}, None),
    ({"risks": [RISK | {"page": "2"}]}, None), ({"risks": "abc"}, "risks.list"), ({"risks": None}, "risks.list"), ({"risks": {}}, "risks.list"),
    ({"risks": [1]}, "risks.item"), ({"risks": [RISK, None]}, "risks.item"), ({"risks": [RISK | {"page": "x"}]}, "risks.item"),
    ({"risks": [RISK | {"page": 0}]}, "risks.item"), ({"risks": [RISK | {"page": 1.5}]}, "risks.item"), ({"risks": [RISK | {"type": ""}]}, "risks.item"),
    ({"risks": [RISK | {"summary": 4}]}, "risks.item"), ({"risks": [RISK | {"more": 1}]}, "risks.unexpected_field"),
    ({"summary": 5}, "summary"), ({"summary": None}, "summary"), ({"summary": ""}, "summary"), ({"sentiment": "bullish"}, "sentiment"),
    ({"extracted_metrics": [METRIC | {"value": [1]}]}, "extracted_metrics.item"), ({"extracted_metrics": [METRIC | {"value": None}]}, "extracted_metrics.item"),
    ({"extracted_metrics": [METRIC | {"value": ""}]}, None), ({"extracted_metrics": [METRIC | {"value": 1.5}]}, None),
    ({"extracted_metrics": [METRIC | {"raw_value_text": 3}]}, "extracted_metrics.item"), ({"extracted_metrics": [METRIC | {"raw_value_text": None}]}, None),
    ({"записка": 1}, "unexpected_field"), ({"my-score": 1}, "unexpected_field"), ({"risks": [RISK | {"a": {"b": [{"SCORE": 1}]}}]}, "forbidden_field"),
    ({"summary": 'say "score": yes'}, None),
]


def test_status_of_each_case(spark):
    rows = [(i, "body", json.dumps(HEAD | extra, ensure_ascii=False)) for i, (extra, _) in enumerate(CASES)]
    rows += [(100, "body", "[1]"), (101, "body", '{"a"'), (102, "body", None), (103, " ", "{}")]
    df = spark.createDataFrame(rows, "id int, body string, response string")
    got = {r.id: (r.status, r.error) for r in ex.validate_responses(df).collect()}
    for i, (extra, error) in enumerate(CASES):
        assert got[i] == (("schema_invalid", error) if error else ("success", None)), extra
    assert got[100][1] == got[101][1] == "invalid_json" and got[102][0] == "llm_error" and got[103][0] == "missing_body"


@pytest.mark.parametrize(
    ("raw", "value", "evidence", "matched"),
    [("１２", "x", "total 12", 1), (" ", "x", "no thing", 0), (None, "7", "７ units", 1), ("", "12", "in body", 1), (None, "", "any", 0), ("99", "12", "none", 0)],
)
def test_metric_matching_is_normalised(spark, raw, value, evidence, matched):
    metric = {"metric_name": "m", "value": value, "evidence_text": evidence, "raw_value_text": raw}
    response = json.dumps(HEAD | {"extracted_metrics": [metric]}, ensure_ascii=False)
    df = spark.createDataFrame([(1, "body with 12 in it", "buyback", response)], "id int, body string, rule_type string, response string")
    valid = ex.validate_responses(df).filter("status = 'success'")
    located = ex.locate(ex.evidence_references(valid, "id", ["body"]), "body")
    (row,) = ex.confidence(valid, located, "id", "body").collect()
    assert row.matched_metrics == matched and row.total_metrics == 1
