"""Small hand-made cases for scores, labels, events, orders, text and ingest."""

from datetime import date as D

import pytest

from tidemark.functions import columns as col
from tidemark.operators import extraction as ex
from tidemark.operators import factors as fx
from tidemark.operators import portfolio as pf
from tidemark.operators import quality as qa
from tidemark.operators import scoring as sc
from tidemark.operators import selection as se
from tidemark.operators import validation as va
from tidemark.params import VALIDATION_GATE, select_factors
from tidemark.sources import prepare as pr
from tidemark.sources import readers as rd
from tidemark.sources import writers as wr

DAY = D(2026, 1, 5)


def long(spark, rows):
    return spark.createDataFrame(
        [(e, DAY, n, v, DAY) for e, n, v in rows],
        "entity int, trade_date date, factor_name string, factor_value double, as_of_date date",
    )


def test_normalized_scores_ties_single_and_constant(spark):
    rows = [(1, "return_20d", 1.0), (2, "return_20d", 2.0), (3, "return_20d", 2.0)]
    rows += [(1, "pb_percentile", 7.0)] + [(e, "above_ma60", 1.0) for e in (1, 2)]
    got = {(r.factor_name, r.entity): r.normalized_score for r in sc.normalized_scores(long(spark, rows)).collect()}
    assert [got[("return_20d", e)] for e in (1, 2, 3)] == [0.0, 75.0, 75.0]
    assert got[("pb_percentile", 1)] == 50.0
    assert got[("above_ma60", 1)] == got[("above_ma60", 2)] == 50.0


def test_group_score_needs_half_of_the_weight(spark):
    rows = [(1, "revenue_yoy", 1.0), (1, "profit_yoy", 1.0), (2, "operating_cashflow_to_profit", 1.0), (2, "return_20d", 1.0)]
    normalized = sc.normalized_scores(long(spark, rows))
    universe = spark.createDataFrame([(1, DAY), (2, DAY)], "entity int, trade_date date")
    grouped = {r.entity: r for r in sc.group_scores(sc.wide_scores(normalized, universe)).collect()}
    assert grouped[1].financial_score == 50.0 and grouped[2].financial_score is None
    assert grouped[2].momentum_score is not None


def test_missing_filter_excludes(spark):
    rows = [(1, n, 0.0) for n in ("is_st", "is_suspended", "is_delisted", "low_liquidity")]
    rows += [(2, n, 0.0) for n in ("is_st", "is_suspended", "is_delisted")] + [(3, "is_st", 1.0)]
    universe = spark.createDataFrame([(e, DAY) for e in (1, 2, 3)], "entity int, trade_date date")
    store = long(spark, rows)
    assert [r.entity for r in sc.passed(store, universe).collect()] == [1]
    found = {(r.entity, r.hard_filter_name): r.exclusion_reason for r in sc.hard_filter_exclusions(store, universe).collect()}
    assert found[(2, "low_liquidity")] == "missing_hard_filter" and found[(3, "is_st")] == "failed_hard_filter"
    assert not any(e == 1 for e, _ in found)


def test_rank_ic_constant_side_is_null_and_direction_flips(spark):
    def rows(name, values):
        return [(e, name, DAY, 5, v, float(e)) for e, v in enumerate(values)]

    data = rows("return_20d", [1.0, 2.0, 3.0]) + rows("volatility_20d", [3.0, 2.0, 1.0]) + rows("above_ma60", [1.0, 1.0, 1.0])
    data += rows("return_60d", [1.0, 2.0])
    df = spark.createDataFrame(
        data, "entity int, factor_name string, trade_date date, horizon int, factor_value double, forward_return double"
    )
    got = {r.factor_name: r for r in va.rank_ic(df, 3).collect()}
    assert got["return_20d"].rank_ic == pytest.approx(1.0)
    assert got["volatility_20d"].rank_ic == pytest.approx(-1.0) and got["volatility_20d"].oriented_rank_ic == pytest.approx(1.0)
    assert got["above_ma60"].rank_ic is None
    assert got["return_60d"].rank_ic is None and got["return_60d"].valid_n == 2


def test_group_returns_bucket_by_floor(spark):
    data = [(e, "return_20d", DAY, 5, float(e), float(e)) for e in range(10)]
    df = spark.createDataFrame(
        data, "entity int, factor_name string, trade_date date, horizon int, factor_value double, forward_return double"
    )
    row = va.group_returns(df, 4, 1).first()
    assert row.bottom_return == pytest.approx(1.0)  # entities 0, 1, 2
    assert row.top_return == pytest.approx(8.5)  # entities 8, 9
    assert row.valid_group_size == 2
    assert va.group_returns(df, 4, 3).count() == 0


def test_unknown_factor_fails_and_order_is_kept():
    assert select_factors(["return_60d", "return_20d", "return_60d"]) == ["return_60d", "return_20d"]
    with pytest.raises(ValueError):
        select_factors(["nope"])


def test_adj_factor_jump_and_suspended_rows_count(spark):
    rows = [(1, D(2026, 1, d), 10.0 if d < 21 else 5.0, 1.0 if d < 21 else 2.0, 1.0, d % 2 == 0) for d in range(1, 23)]
    prices = spark.createDataFrame(
        rows, "entity int, trade_date date, close double, adj_factor double, amount double, is_suspended boolean"
    )
    got = {r.trade_date: r.return_20d for r in fx.price_factors(prices, ["return_20d"]).collect()}
    assert got[D(2026, 1, 21)] == pytest.approx(0.0) and got[D(2026, 1, 20)] is None


def test_missing_price_row_is_suspended_and_null_flag_is_not(spark):
    universe = spark.createDataFrame([(1, DAY), (2, DAY)], "entity int, trade_date date")
    prices = spark.createDataFrame([(2, DAY, None)], "entity int, trade_date date, is_suspended boolean")
    securities = spark.createDataFrame([], "entity int, list_date date, delist_date date, delist_effective date")
    st = spark.createDataFrame(
        [], "entity int, in_date date, in_publish date, in_effective date, out_date date, out_publish date, out_effective date"
    )
    dates = spark.createDataFrame([(DAY,)], "trade_date date")
    got = {r.entity: r.is_suspended for r in fx.flag_factors(universe, prices, securities, st, dates).collect()}
    assert got == {1: 1.0, 2: 0.0}


def test_gate_reasons_in_order(spark):
    coverage = spark.createDataFrame([("return_20d", 0.9), ("above_ma60", 0.1)], "factor_name string, coverage double")
    ic = spark.createDataFrame(
        [("return_20d", 20, 5, 0.1, 0.2), ("above_ma60", 20, 0, None, None)],
        "factor_name string, horizon int, valid_oriented_ic_dates int, mean_oriented_rank_ic double, oriented_icir double",
    )
    groups = spark.createDataFrame([("return_20d", 20)], "factor_name string, horizon int")
    gate = {r.factor_name: r for r in sc.validation_gate(coverage, ic, groups, gate=VALIDATION_GATE).collect()}
    assert gate["return_20d"].validation_status == "PASS" and gate["return_20d"].reason == "passed"
    assert gate["above_ma60"].reason.split("; ") == [
        "coverage 0.1 below minimum 0.2",
        "horizon 20 valid_oriented_ic_dates below minimum",
        "horizon 20 mean_oriented_rank_ic below minimum",
        "horizon 20 missing group_returns rows",
    ]
    assert gate["revenue_yoy"].reason == "factor missing from coverage.csv; missing ic_summary horizon 20"


def test_scenarios_keep_weights_summing_to_one():
    for s in sc.scenarios():
        groups = s["config"]["groups"]
        assert sum(g["weight"] for g in groups.values()) == pytest.approx(1.0)
        assert all(sum(g["factors"].values()) == pytest.approx(1.0) for g in groups.values() if g["enabled"])
    assert len(sc.scenarios()) == 22


def test_trade_costs_and_lots(spark):
    df = spark.createDataFrame([("buy", 1000.0), ("sell", 100000.0)], "side string, n double")
    got = {r.side: r.c for r in df.selectExpr("side", f"{pf.trade_costs('side', 'n')} AS c").collect()}
    assert (got["buy"].commission, got["buy"].stamp_tax) == (5.0, 0.0)
    assert (got["sell"].commission, got["sell"].stamp_tax) == (25.0, 100.0)
    lots = spark.createDataFrame([(250.0, 250.0), (160.0, 250.0), (249.0, 250.0), (30.0, 230.0)], "r double, h double")
    sells = [r.s for r in lots.selectExpr(f"{pf.round_sell('r', 'h', 100)} AS s").collect()]
    assert sells == [250.0, 150.0, 200.0, 30.0]


def test_scan_direction_ties_and_missing_display(spark):
    names = ["return_20d", "pe_ttm_percentile", "is_st", "is_suspended", "is_delisted", "low_liquidity"]
    rows = [(e, f, 0.0) for e in (1, 2, 3) for f in names[2:]]
    rows += [(1, "return_20d", 0.5), (2, "return_20d", 0.5), (3, "return_20d", -0.1), (3, "pe_ttm_percentile", 0.9)]
    wide = se.to_wide(long(spark, rows), names)
    got = se.scan(wide, "return_20d", 2).orderBy("rank").collect()
    assert [r.entity for r in got] == [1, 2]
    tips = {r.entity: r.t for r in wide.selectExpr("entity", f"{se.risk_tips(names[:2], names[:2])} AS t").collect()}
    assert tips[1] == "展示因子缺失：pe_ttm_percentile"
    assert tips[3] == "估值处于自身历史高位；20 日动量为负"


def test_interval_overlap_kinds(spark):
    rows = [
        ("a", D(2026, 1, 1), D(2026, 1, 10)), ("a", D(2026, 1, 5), None), ("a", D(2026, 2, 1), None),
        ("b", D(2026, 1, 1), D(2026, 1, 5)), ("b", D(2026, 1, 5), None),
    ]
    df = spark.createDataFrame(rows, "k string, in_effective date, out_effective date")
    got = {(r.k, r.in_effective): r.issue for r in qa.interval_overlaps(df, ["k"]).collect()}
    assert got == {("a", D(2026, 1, 5)): "overlap", ("a", D(2026, 2, 1)): "open_ended_overlap"}


def test_overlaps_with_an_interval_further_back(spark):
    month = lambda m: D(2026, m, 1)
    rows = [(1, month(1), month(12)), (1, month(2), month(3)), (1, month(5), month(6)), (1, D(2026, 12, 1), None), (1, D(2027, 1, 1), D(2027, 2, 1))]
    df = spark.createDataFrame(rows, "k int, in_effective date, out_effective date")
    got = {r.in_effective: (r.issue, r.prev_in, r.prev_out) for r in qa.interval_overlaps(df, ["k"]).collect()}
    covered = ("overlap", month(1), month(12))
    assert got == {month(2): covered, month(5): covered, D(2027, 1, 1): ("open_ended_overlap", D(2026, 12, 1), None)}
    assert pr.import_findings(df.selectExpr("'t' AS source_tag", "'X' AS index_code", "k AS entity", "in_effective", "out_effective")).count() == 3


def test_stock_codes_and_text(spark):
    raw = ["000001.SZ", "sh600001", "600001sh", "830001", " 300001_sz ", "700001", "", None]
    df = spark.createDataFrame([(x,) for x in raw], "x string")
    got = [r.c for r in df.selectExpr(f"{col.stock_code('x')} AS c").collect()]
    assert got == ["000001.SZ", "600001.SH", "600001.SH", "830001.BJ", "300001.SZ", None, None, None]
    text = spark.createDataFrame([("﻿Ａ１　x\r\n y ",), ("plain  text",)], "t string")
    assert [r.n for r in col.normalize_text(text, "t", "n").collect()] == ["A1 x y", "plain text"]


def test_rule_order_beats_source_order(spark):
    df = spark.createDataFrame(
        [("buyback", "年报摘要"), (None, "Share REPURCHASE"), ("other", "nothing")], "p string, t string"
    )
    got = [(r.announcement_type, r.matched_text, r.reason) for r in ex.classify(df, "p", "t").collect()]
    assert got[0] == ("earnings_report", "年报摘要", "title matched earnings_report_keyword")
    assert got[1][:2] == ("buyback", "repurchase")
    assert got[2][0] == "other"


def test_forbidden_key_at_any_depth(spark):
    good = (
        '{"schema_version":"phase2.v1","announcement_type":"buyback","sentiment":"neutral","summary":"s",'
        '"risks":[{"type":"t","summary":"s","evidence_text":"e"%s}]}'
    )
    rows = [(good % "", "b"), (good % ',"page":0', "b"), (good % ',"Score":1', "b"), (good % ',"x":1', "b"), ("[1]", "b"), ("{", "b"), (None, "b"), (good % "", " ")]
    df = spark.createDataFrame(rows, "response string, body string")
    got = [(r.status, r.error) for r in ex.validate_responses(df).select("status", "error").collect()]
    assert got == [
        ("success", None), ("schema_invalid", "risks.item"), ("schema_invalid", "forbidden_field"),
        ("schema_invalid", "risks.unexpected_field"), ("schema_invalid", "invalid_json"), ("schema_invalid", "invalid_json"),
        ("llm_error", "no_response"), ("missing_body", "body_missing"),
    ]


def test_several_sources_fail(spark):
    one = spark.createDataFrame([("x",), ("legacy",), (" ",)], "source string")
    assert pr.resolve_source([one]).first().source == "x"
    with pytest.raises(Exception, match="several data sources"):
        pr.resolve_source([one, spark.createDataFrame([("y",)], "source string")]).collect()


def test_range_replace_removes_stale_dates(spark):
    old = spark.createDataFrame([(1, DAY), (1, D(2026, 1, 6)), (1, D(2026, 2, 1))], "entity int, trade_date date")
    new = spark.createDataFrame([(2, DAY)], "entity int, trade_date date")
    out = wr.replace_range(old, new, "trade_date BETWEEN DATE'2026-01-01' AND DATE'2026-01-31'")
    assert sorted((r.entity, r.trade_date) for r in out.collect()) == [(1, D(2026, 2, 1)), (2, DAY)]


def test_duplicate_factor_append_fails(spark, tmp_path):
    schema = "source_run_id string, entity int, trade_date date, as_of_date date, factor_name string, factor_value double"
    rows = [("r", 1, DAY, DAY, "f", 1.0)]
    store = spark.createDataFrame([], schema)
    wr.append_factor_rows(store, spark.createDataFrame(rows, schema), str(tmp_path / "s"))
    with pytest.raises(ValueError):
        wr.append_factor_rows(store, spark.createDataFrame(rows * 2, schema), str(tmp_path / "t"))


def test_unexpected_columns_fail(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        rd.check_columns(df, ["a", "c"])
    with pytest.raises(ValueError):
        rd.check_columns(df, ["a"], ["a"])


def test_overlapping_member_import_needs_overwrite(spark):
    schema = "entity int, index_code string, source_tag string"
    old = spark.createDataFrame([(1, "X", "a"), (2, "Y", "a")], schema)
    new = spark.createDataFrame([(3, "X", "a")], schema)
    assert sorted(r.entity for r in pr.import_members(old, new, True).collect()) == [2, 3]
    with pytest.raises(Exception, match="already present"):
        pr.import_members(old, new, False).collect()


def test_rejected_and_delisted_positions_leave_the_held_weights_as_they_are(spark):
    days = ["2024-01-31", "2024-02-01", "2024-02-29", "2024-03-01", "2024-03-29", "2024-04-01", "2024-04-02"]
    calendar = spark.createDataFrame([(d, True) for d in days], "d string, is_open boolean").selectExpr("DATE(d) AS trade_date", "is_open")
    # up: bought at its limit, then again; stuck: suspended when it should be sold; gone: delisted while it is held; dear: below one lot.
    targets = [("2024-01-31", e) for e in ("up", "stuck", "gone", "dear")] + [("2024-02-29", "up"), ("2024-02-29", "gone"), ("2024-03-29", "gone")]
    targets = spark.createDataFrame([(d, e, 0.25) for d, e in targets], "d string, entity string, target_weight double").selectExpr("DATE(d) AS signal_date", "entity", "target_weight")
    price = {"up": 10.0, "stuck": 10.0, "gone": 10.0, "dear": 9000.0}
    rows = [
        (e, d, price[e], e == "stuck" and d == "2024-03-01", price[e] if (e, d) == ("up", "2024-02-01") else 1e6, 0.0)
        for e in price for d in days if not (e == "gone" and d > "2024-03-01")
    ]
    prices = spark.createDataFrame(rows, "entity string, d string, open double, is_suspended boolean, limit_up double, limit_down double").selectExpr("*", "DATE(d) AS trade_date")
    securities = spark.createDataFrame([("gone", "2024-03-20")], "entity string, d string").selectExpr("entity", "DATE(d) AS delist_date", "DATE(d) AS delist_effective")
    orders = pf.held_orders(targets, calendar, 1e6, prices, securities)
    got = {(r.entity, str(r.execution_date)): (r.side, r.old_weight, r.new_weight, r.weight_after) for r in orders.collect()}
    assert got == {
        ("up", "2024-02-01"): ("buy", 0.0, 0.25, 0.0), ("up", "2024-03-01"): ("buy", 0.0, 0.25, 0.25), ("up", "2024-04-01"): ("sell", 0.25, 0.0, 0.0),
        ("stuck", "2024-02-01"): ("buy", 0.0, 0.25, 0.25), ("stuck", "2024-03-01"): ("sell", 0.25, 0.0, 0.25), ("stuck", "2024-04-01"): ("sell", 0.25, 0.0, 0.0),
        ("gone", "2024-02-01"): ("buy", 0.0, 0.25, 0.25), ("gone", "2024-04-01"): ("buy", 0.0, 0.25, 0.0),
        ("dear", "2024-02-01"): ("buy", 0.0, 0.25, 0.0),
    }
    # The ledger of these orders tells the same story.
    ledger = pf.execute_orders(pf.classify_orders(orders, prices, securities))
    rejected = {(r.entity, str(r.execution_date)): r.reject_reason for r in ledger.filter("order_status = 'rejected'").collect()}
    assert rejected == {("up", "2024-02-01"): "limit_up", ("stuck", "2024-03-01"): "suspended", ("gone", "2024-04-01"): "delisted", ("dear", "2024-02-01"): "below_board_lot"}
    exits = pf.exits_of(pf.held_periods(orders), securities, calendar)
    assert [(r.entity, str(r.exit_date)) for r in exits.collect()] == [("gone", "2024-03-29")]
    returns = prices.selectExpr("entity", "trade_date", "0.1D AS ret")
    daily = {str(r.trade_date): (round(r.gross_return, 9), r.turnover) for r in pf.target_portfolio(orders, exits, calendar, returns, "2024-01-01").collect()}
    assert [daily[d][0] for d in days] == [0.0, 0.0, 0.05, 0.05, 0.05, 0.05, 0.0]
    assert [daily[d][1] for d in days] == [0.0, 0.5, 0.0, 0.25, 0.0, 0.5, 0.0]
