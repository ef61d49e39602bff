"""The universe as intervals: no table of members and dates is sent to tasks, and rows are the same as with that table."""

from datetime import date, timedelta
from types import SimpleNamespace

import pytest

from tidemark.operators import factors as fx
from tidemark.plans.views import Tables

DAYS = [date(2020, 1, 6) + timedelta(7 * i) for i in range(12)]
MEMBERS = "entity long, index_code string, in_date date, in_effective date, out_date date, out_effective date"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("include_delisted", [True, False])
def test_rows_in_the_universe_equal_a_join_with_its_dates(spark, include_delisted):
    d = DAYS
    members = spark.createDataFrame(
        [(1, "X", d[0], None, None, None), (1, "X", d[2], None, d[5], None), (2, "X", d[1], d[3], d[6], d[8]), (2, "X", d[10], None, None, None),
         (3, "X", d[5], None, d[2], None), (4, "Y", d[0], None, None, None), (5, "X", None, None, None, None), (None, "X", d[0], None, None, None)],
        MEMBERS,
    )
    gone = "entity long, delist_date date, delist_effective date"
    securities = spark.createDataFrame([(1, d[7], None), (1, d[7], d[9]), (2, None, None)], gone)
    rows = spark.createDataFrame([(e, day, float(i)) for e in (1, 2, 3, 4, 5, 6, None) for i, day in enumerate([*d, None])], "entity long, trade_date date, v double")
    dates = spark.createDataFrame([(x,) for x in [*d[:-1], d[0]]], "trade_date date")
    args = (members, securities, dates, "X", include_delisted)
    want = rows.join(fx.calculation_universe(*args), ["entity", "trade_date"], "left_semi")
    form = lambda df: sorted((r.entity, r.trade_date, r.v) for r in df.collect())
    assert form(fx.in_universe(rows, *args)) == form(want) != []


def test_price_factors_of_members_list_no_dates_of_members(spark):
    d = DAYS
    prices = spark.createDataFrame([(e, day, 1.0 + e + i, None, 5.0) for e in range(6) for i, day in enumerate(d)], "entity long, trade_date date, close double, adj_factor double, amount double")
    t = SimpleNamespace(
        prices=prices, members=spark.createDataFrame([(e, "X", d[0], None, None, None) for e in range(4)], MEMBERS),
        securities=spark.createDataFrame([], "entity long, delist_date date, delist_effective date"),
    )
    params = {**fx.FACTOR_PARAMS, "return_short": 2, "return_long": 3, "amount_window": 2}
    dates = spark.createDataFrame([(x,) for x in d], "trade_date date")
    out = fx.all_factors(t, dates, ["return_20d", "return_60d", "amount_cv_20d"], params=params)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    leaves = out._jdf.queryExecution().optimizedPlan().collectLeaves()
    # No stored table of members and dates, and none made here.
    assert "sequence(" not in plan and not any("stage-" in str(leaves.apply(i)) for i in range(leaves.size()))
    assert out.groupBy("factor_name").count().count() == 3 and out.filter("entity > 3").count() == 0


def test_the_panel_is_shuffled_once(spark):
    t = Tables(spark, "/nowhere")
    t.raw = lambda name: spark.createDataFrame(
        [(s % 5, date(1996, 1, 1) + timedelta(s % 40), 2.0 + s % 3, 10.0 + s, 0.1, 0.2, "R" if s % 4 else "N") for s in range(200)],
        "l_suppkey long, l_shipdate date, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string",
    )
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert exchanges(t._panel().repartition(buckets, "entity")) == 1
    t.stored = lambda name, build, *_: build()
    got = t.panel.filter("entity = 1 AND trade_date = DATE'1996-01-01'").first()
    own = [(2.0 + s % 3, 10.0 + s) for s in range(200) if s % 5 == 1 and s % 40 < 7]
    close = sum(p * 0.9 for _, p in own) / sum(q for q, _ in own)
    assert got.close == pytest.approx(close) and got.limit_up == pytest.approx(close * 1.1) and got.high == max(p / q for q, p in own)
    assert t.panel.columns == ["entity", "trade_date", "open", "high", "low", "close", "volume", "amount", "adj_factor", "is_suspended",
                               "limit_up", "limit_down", "pe_ttm", "pb", "total_mv", "float_mv"]
