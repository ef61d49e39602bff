"""Range runs: the rows that windows reach, and how little of a long panel is read for them."""

import random
from datetime import date, timedelta
from types import SimpleNamespace

import pytest

from tidemark.functions.calendar import open_days
from tidemark.operators import factors as fx
from tidemark.params import FACTOR_ORDER, FACTOR_PARAMS
from tidemark.session import shared_dir
from tidemark.sources.history import History, by_month, month_counts, month_number

SCHEMA = "entity long, trade_date date, close double, adj_factor double, amount double, is_suspended boolean, pe_ttm double, pb double, total_mv double, float_mv double"
SMALL = {**FACTOR_PARAMS, "return_short": 3, "return_long": 7, "ma_window": 6, "volatility_window": 4, "drawdown_window": 8,
         "amount_window": 5, "valuation_window": 12, "valuation_min_observations": 3}


def panel(n_entities, n_days, gaps, seed=1, first=date(2015, 1, 1)):
    rng = random.Random(seed)
    days = [d for d in (first + timedelta(i) for i in range(n_days)) if d.weekday() < 5]
    rows = []
    for e in range(n_entities):
        for i, d in enumerate(days):
            if not gaps(e, i, rng):
                price = round(rng.uniform(5, 50), 2)
                rows.append((e, d, price, rng.choice([None, 1.5]), rng.uniform(1, 9), rng.random() < 0.1, rng.choice([-1.0, price / 3, 4.0]), rng.choice([None, 2.0, price]), 1.0, None))
    return rows, days


def tables(spark, rows, days):
    df = spark.createDataFrame(rows, SCHEMA)
    entities = sorted({r[0] for r in rows})
    interval = "in_date date, in_effective date, out_date date, out_effective date"
    span = (days[0], days[0], None, None)
    members = spark.createDataFrame([(e, "X", *span) for e in entities], f"entity long, index_code string, {interval}")
    industries = spark.createDataFrame([(e, "a" if e % 2 else "b", "c", *span) for e in entities], f"entity long, industry_l1 string, industry_l2 string, {interval}")
    return SimpleNamespace(
        prices=df.drop("pe_ttm", "pb", "total_mv", "float_mv"),
        valuations=df.select("entity", "trade_date", "pe_ttm", "pb", "total_mv", "float_mv"),
        calendar=spark.createDataFrame([(d, True) for d in days], "trade_date date, is_open boolean"),
        members=members, industries=industries,
        securities=spark.createDataFrame([(e, days[0], None, None) for e in entities], "entity long, list_date date, delist_date date, delist_effective date"),
        st_status=spark.createDataFrame([], f"entity long, {interval}"),
        fundamentals=spark.createDataFrame([], "entity long, report_period date, publish_time date, effective_date date, revenue double, net_profit double, operating_cashflow double"),
    ), df


def history(df):
    rows = by_month(df).persist()
    return History(rows, month_counts(rows, fx.HISTORY_KINDS))


def gappy(e, i, rng):
    # Entity 0 is whole, 1 is sparse, 2 rests for months, 3 is new, 4 is gone before the range, 5 has one old row.
    return [False, rng.random() < 0.8, 60 < i < 240, i < 235, i > 150, 3 < i < 250][e]


@pytest.mark.parametrize("start,end", [("2015-12-10", "2015-12-22"), ("2017-01-01", "2017-02-01")])
def test_a_range_run_equals_the_whole_run(spark, start, end):
    t, df = tables(spark, *panel(6, 400, gappy))
    want = fx.all_factors(t, open_days(t.calendar, start, end), FACTOR_ORDER, params=SMALL)
    got = fx.range_factors(t, history(df), start, end, FACTOR_ORDER, params=SMALL)
    form = lambda rows: sorted((r.entity, r.trade_date, r.factor_name, round(r.factor_value, 9)) for r in rows.collect())
    want = form(want)
    assert form(got) == want and (want or start > "2016-12")


def test_reach_has_enough_rows_and_asks_older_months_of_few(spark):
    rows, days = panel(6, 400, gappy)
    t, df = tables(spark, rows, days)
    h = history(df)
    for n in (1, 8, 30):
        got = [(r.entity, r.trade_date) for r in h.reach("rows", t.calendar, "2015-12-10", "2015-12-22", n).collect()]
        for e in range(6):
            own = sorted(d for x, d, *_ in rows if x == e and d <= date(2015, 12, 22))
            have = sorted(d for x, d in got if x == e)
            if any(d >= date(2015, 12, 1) for d in own):
                before = [d for d in own if d < date(2015, 12, 10)]
                assert have == own[-len(have) :] and len([d for d in have if d < date(2015, 12, 10)]) >= min(n, len(before))
        first = h.first_month(t.calendar, "2015-12-10", n)
        older = {r.entity for r in h.older("rows", first, "2015-12-10", "2015-12-22", n).collect()}
        assert 0 not in older and 4 not in older


def test_one_month_of_ten_years_reads_little(spark):
    path = f"{shared_dir(spark)}/history-{random.random()}"
    dates = spark.sql("SELECT explode(sequence(DATE'2010-01-01', DATE'2019-12-31')) AS trade_date").filter("weekday(trade_date) < 5")
    values = "entity, trade_date, 1D + entity AS close, 1D AS adj_factor, rand(3) AS amount, false AS is_suspended, rand(1) AS pe_ttm, rand(2) AS pb, 1D AS total_mv, 1D AS float_mv"
    # One entity of forty has nothing in 2018.
    df = spark.range(40).withColumnRenamed("id", "entity").crossJoin(dates).filter("entity <> 7 OR year(trade_date) <> 2018").selectExpr(*values.split(", "))
    History.append(df.filter("trade_date < '2019-06-01'"), fx.HISTORY_KINDS, path)
    History.append(df.filter("trade_date >= '2019-06-01'"), fx.HISTORY_KINDS, path)
    h = History.open(spark, path, SCHEMA, fx.HISTORY_KINDS)
    calendar = dates.selectExpr("trade_date", "true AS is_open")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        def read(frame):
            frame.collect()
            leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
            scans = [leaves.apply(i) for i in range(leaves.size()) if "filesSize" in str(leaves.apply(i).metrics().keys())]
            return sum(s.metrics().apply("filesSize").value() for s in scans)

        whole = read(h.rows)
        for kind, n in fx.rows_before(FACTOR_ORDER).items():
            reached = h.reach(kind, calendar, "2019-11-01", "2019-11-30", n)
            near = h.rows.filter(f"month BETWEEN {h.first_month(calendar, '2019-11-01', n)} AND {month_number('2019-11-30')}")
            assert read(near) < 0.15 * whole
            # The entity with the gap reads its own rows of older months as well.
            days = {r[0] for r in reached.filter("entity = 7 AND trade_date < '2018-01-01'").select("trade_date").collect()}
            assert bool(days) == (n > 200) and reached.filter("entity <> 7 AND trade_date < '2018-10-01'").count() == 0
            assert reached.filter("entity = 7 AND trade_date < '2019-11-01'").count() >= n
        assert read(h.counts) < 0.05 * whole
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
