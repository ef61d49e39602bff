"""Window folds in blocks against the windows themselves."""

import math
import random
from datetime import date, timedelta
from types import SimpleNamespace

import pytest

from tidemark.operators import factors as fx
from tidemark.params import FACTOR_PARAMS

SCHEMA = "entity long, trade_date date, close double, adj_factor double, amount double, pe_ttm double"


def table(spark, seed, lengths, values):
    rng = random.Random(seed)
    rows = [(e, date(2020, 1, 1) + timedelta(i * 2), rng.choice(values) if values else rng.uniform(1, 9), None, 1.0, rng.choice([None, -1.0, 0.0, 2.0, 2.0, 3.5, rng.random()]))
            for e, n in enumerate(lengths) for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("n", [1, 2, 5, 60])
def test_drawdown(spark, n):
    rows, df = table(spark, n, [1, n - 1, n, n + 1, 3 * n + 2, 130], [None, 0.0, -2.0] + [1.0, 2.0, 5.0, 7.5] * 40)
    got = {(r.entity, r.trade_date): r.max_drawdown_60d for r in fx.price_factors(df, ["max_drawdown_60d"], {**FACTOR_PARAMS, "drawdown_window": n}).collect()}
    assert len(got) == len(rows)
    some = 0
    for e in range(6):
        series = sorted((r[1], r[2]) for r in rows if r[0] == e)
        for i, (day, _) in enumerate(series):
            last = [p for _, p in series[max(0, i - n + 1) : i + 1]]
            want = None
            if len(last) == n and all(p is not None and p > 0 for p in last):
                want = max(1 - last[j] / max(last[: j + 1]) for j in range(n))
                some += want > 0
            assert got[(e, day)] == want or math.isclose(got[(e, day)], want, abs_tol=1e-12), (e, i)
    assert some or n == 1


@pytest.mark.parametrize("window,least", [(252, 20), (12, 2), (7, 1), (1, 1), (30, 3)])
def test_percentile(spark, window, least):
    rows, df = table(spark, window, [0, 1, 5, 40, 700], None)
    params = {**FACTOR_PARAMS, "valuation_window": window, "valuation_min_observations": least}
    got = {(r.entity, r.trade_date): r.p for r in fx.history_percentile(df, "pe_ttm", "p", params).collect()}
    want = {}
    for e in range(5):
        series = sorted((r[1], r[5]) for r in rows if r[0] == e and r[5] is not None and r[5] > 0)
        for i, (day, v) in enumerate(series):
            seen = [x for _, x in series[max(0, i - window + 1) : i + 1]]
            if len(seen) >= max(2, least):
                want[(e, day)] = (sum(x < v for x in seen) + 0.5 * sum(x == v for x in seen) - 0.5) / (len(seen) - 1)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)


@pytest.mark.parametrize("window,least", [(252, 20), (12, 2), (7, 1), (1, 1), (30, 3)])
def test_percentile_of_some_dates_sees_all_earlier_values(spark, window, least):
    _, df = table(spark, window, [0, 1, 5, 40, 700], None)
    params = {**FACTOR_PARAMS, "valuation_window": window, "valuation_min_observations": least}
    days = [date(2020, 1, 1) + timedelta(i) for i in (0, 8, 12, 70, 330, 990, 1000, 1390, 5000)]
    dates = spark.createDataFrame([(d,) for d in [*days, days[3], None]], "trade_date date")
    some = fx.history_percentile(df, "pe_ttm", "p", params, dates)
    whole = fx.history_percentile(df, "pe_ttm", "p", params)
    got = sorted((r.entity, r.trade_date, r.p) for r in some.collect())
    assert got == sorted((r.entity, r.trade_date, r.p) for r in whole.collect() if r.trade_date in days)
    assert got or window == 1


def test_factors_of_some_dates_rank_only_their_values(spark, monkeypatch):
    seen = []
    real = fx.history_percentile
    monkeypatch.setattr(fx, "history_percentile", lambda *a: seen.append(real(*a)) or seen[-1])
    _, df = table(spark, 3, [40, 700, 300], None)
    tables = SimpleNamespace(
        valuations=df.select("entity", "trade_date", "pe_ttm"),
        members=spark.createDataFrame(
            [(e, "X", date(2019, 1, 1), None, None, None) for e in range(2)],
            "entity long, index_code string, in_date date, in_effective date, out_date date, out_effective date",
        ),
        securities=spark.createDataFrame([], "entity long, delist_date date, delist_effective date"),
    )
    day = date(2020, 3, 1)
    got = fx.all_factors(tables, spark.createDataFrame([(day,)], "trade_date date"), ["pe_ttm_percentile"])
    ranked = {(r.entity, r.trade_date): r.pe_ttm_percentile for r in seen[0].collect()}
    assert {d for _, d in ranked} <= {day}
    whole = {(r.entity, r.trade_date): r.p for r in real(df, "pe_ttm", "p").collect()}
    assert {(r.entity, r.trade_date): r.factor_value for r in got.collect()} == {k: v for k, v in whole.items() if k[0] < 2 and k[1] == day}


def test_no_rows_and_plans_without_long_lists(spark):
    _, df = table(spark, 1, [0], None)
    assert fx.history_percentile(df, "pe_ttm", "p").count() == 0 and fx.price_factors(df, ["max_drawdown_60d"]).count() == 0
    plan = fx.price_factors(df, ["max_drawdown_60d"])._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
