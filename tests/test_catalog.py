"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tidemark import catalog
from tests.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
# One query per family keeps the suite short; tests.compare runs them all.
SAMPLE = [
    "a8_normalized_prices", "b7_fill_effective_dates", "c8_interval_overlaps", "d11_members_on_all_dates",
    "e5_max_drawdown_60d", "e13_industry_pe_ttm_percentile", "f3_fingerprint_per_date", "g7_ic_summary",
    "h9_event_summary", "i5_candidate_frame", "j9_ranked_scores", "k12_basket_returns", "l9_quality_gate",
    "m7_located_evidence", "n6_risk_evidence", "o6_table_fingerprints", "a10_appended_store", "a11_scoped_replace",
    "b6_unplaced_facts", "c1_missing_columns", "f1_write_snapshot", "g1_target_dates_wide_calendar", "k5_order_feasibility_empty_month",
    "k13_nav_with_losses", "l1_source_names", "m5_response_status", "n5_rank_changes",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    status, note = compare(
        spark, connect(SF_DIR), name, entry.queries()[name], entry.oracle_sql()[name], SF_DIR
    )
    assert status == "ok", note


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    optional = {n for n in entry.queries() if n not in catalog.QUERIES}
    assert set(entry.queries()) - optional == set(entry.oracle_sql()) - optional


@pytest.mark.parametrize("name", ["e17_above_ma60", "f5_resolved_universe", "g7_ic_summary", "j14_yearly_score_stability", "k16_metrics", "n15_"])
def test_the_panel_is_aggregated_once(spark, name):
    found = [n for n in entry.queries() if n.startswith(name.split("_")[0] + "_")]
    df = entry.queries()[found[0]](spark, SF_DIR)
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    files = [str(leaves.apply(i)) for i in range(leaves.size())]
    assert not any("l_extendedprice" in f for f in files)
