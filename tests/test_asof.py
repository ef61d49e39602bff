"""Visibility edges: late and early exits, revisions, leakage."""

import random
from collections import Counter
from datetime import date as D
from datetime import timedelta

from tidemark.functions import calendar as cal
from tidemark.operators import asof
from tidemark.operators import factors as fx

INTERVAL = (
    "entity int, in_date date, in_publish date, in_effective date, out_date date, out_publish date, out_effective date"
)


def days(spark, *ds):
    return spark.createDataFrame([(d, True) for d in ds], "trade_date date, is_open boolean")


def test_exit_known_before_it_happens_and_exit_not_yet_known(spark):
    rows = [
        (1, D(2026, 1, 5), None, None, D(2026, 1, 20), D(2026, 1, 8), D(2026, 1, 10)),  # known early
        (2, D(2026, 1, 5), None, None, D(2026, 1, 20), D(2026, 1, 21), D(2026, 1, 26)),  # known late
    ]
    df = spark.createDataFrame(rows, INTERVAL)
    on_15 = {r.entity: r.out_date for r in asof.intervals_as_of(df, "2026-01-15").collect()}
    assert on_15 == {1: D(2026, 1, 20), 2: None}
    assert [r.entity for r in asof.intervals_as_of(df, "2026-01-22").collect()] == [2]
    assert asof.intervals_as_of(df, "2026-01-26").count() == 0


def test_many_dates_equal_single_dates(spark):
    rows = [
        (1, D(2026, 1, 5), None, D(2026, 1, 7), D(2026, 1, 20), None, D(2026, 1, 10)),
        (2, D(2026, 1, 6), None, None, None, None, None),
        (3, D(2026, 1, 9), None, None, D(2026, 1, 12), None, None),
    ]
    df = spark.createDataFrame(rows, INTERVAL)
    wanted = [D(2026, 1, d) for d in (5, 6, 7, 9, 11, 12, 19, 20, 21)]
    dates = spark.createDataFrame([(d,) for d in wanted], "d date")
    got = {(r.trade_date, r.entity, r.out_date) for r in asof.intervals_on_dates(df, dates).collect()}
    want = {(d, r.entity, r.out_date) for d in wanted for r in asof.intervals_as_of(df, d).collect()}
    assert got == want


def test_published_fact_needs_both_dates(spark):
    df = spark.createDataFrame(
        [(1, D(2026, 1, 5), D(2026, 1, 6)), (2, D(2026, 1, 7), D(2026, 1, 6))], "entity int, publish_time date, effective_date date"
    )
    assert [r.entity for r in asof.published_as_of(df, "2026-01-06").collect()] == [1]


def test_delisting_visible_before_its_date_is_not_delisted_yet(spark):
    df = spark.createDataFrame(
        [(1, D(2020, 1, 1), D(2026, 1, 20), D(2026, 1, 5), D(2026, 1, 6))],
        "entity int, list_date date, delist_date date, delist_publish date, delist_effective date",
    )
    row = asof.securities_as_of(df, "2026-01-10").first()
    assert row.delist_date == D(2026, 1, 20) and row.is_delisted_as_of is False
    assert asof.securities_as_of(df, "2026-01-20").count() == 0


def test_next_open_and_targets_from_a_closed_day(spark):
    c = spark.createDataFrame(
        [(D(2026, 1, 5), True), (D(2026, 1, 6), False), (D(2026, 1, 7), True), (D(2026, 1, 8), True)],
        "trade_date date, is_open boolean",
    )
    facts = spark.createDataFrame([(D(2026, 1, 4),), (D(2026, 1, 5),), (D(2026, 1, 8),)], "d date")
    got = {r.d: r.n for r in cal.next_open(facts, "d", c, "n").collect()}
    assert got == {D(2026, 1, 4): D(2026, 1, 5), D(2026, 1, 5): D(2026, 1, 7), D(2026, 1, 8): None}
    targets = {(r.trade_date, r.horizon): r.target_date for r in cal.target_dates(c, [1, 2], c).collect()}
    assert targets[(D(2026, 1, 6), 1)] == D(2026, 1, 7) and targets[(D(2026, 1, 6), 2)] == D(2026, 1, 8)
    assert (D(2026, 1, 8), 1) not in targets


def test_revised_report_becomes_visible_later(spark):
    c = days(spark, *[D(2026, 5, d) for d in (1, 4, 5, 6, 7, 8)])
    reports = spark.createDataFrame(
        [
            (1, D(2025, 3, 31), D(2025, 4, 20), D(2025, 4, 21), 100.0, -1.0, 5.0),
            (1, D(2026, 3, 31), D(2026, 5, 1), D(2026, 5, 4), 130.0, 10.0, 5.0),
            (1, D(2026, 3, 31), D(2026, 5, 6), D(2026, 5, 7), 140.0, 20.0, 5.0),
        ],
        "entity int, report_period date, publish_time date, effective_date date, revenue double, net_profit double, operating_cashflow double",
    )
    out = {r.trade_date: r for r in fx.financial_factors(reports, c.select("trade_date")).collect()}
    assert round(out[D(2026, 5, 5)].revenue_yoy, 6) == 0.3
    assert round(out[D(2026, 5, 6)].revenue_yoy, 6) == 0.3
    assert round(out[D(2026, 5, 7)].revenue_yoy, 6) == 0.4
    assert out[D(2026, 5, 7)].profit_yoy is None  # base year not positive
    assert out[D(2026, 5, 1)].revenue_yoy is None  # only last year's report is visible


def test_rows_visible_later_do_not_change_a_result(spark):
    rows = [(1, D(2026, 1, d), 10.0 + d, 1.0, 100.0) for d in range(1, 29)]
    prices = spark.createDataFrame(rows, "entity int, trade_date date, close double, adj_factor double, amount double")
    cut = "trade_date <= DATE'2026-01-24'"
    full = fx.price_factors(prices, ["return_20d", "volatility_20d"]).filter(cut).orderBy("trade_date").collect()
    early = fx.price_factors(prices.filter(cut), ["return_20d", "volatility_20d"]).orderBy("trade_date").collect()
    assert full == early


def test_spans_count_like_rows_per_date(spark):
    """Overlapping, touching, repeated, empty and open intervals, null members; against one row per interval and date."""
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        a = D(2026, 1, 1) + timedelta(days=rng.randrange(60))
        b = None if rng.random() < 0.2 else a + timedelta(days=rng.randrange(0, 15))
        entity, late = rng.choice([None, 1, 2, 3, 4]), a + timedelta(days=3) if rng.random() < 0.2 else None
        rows += [(entity, rng.choice(["X", "Y", None]), a, None, late, b, None, None)] * rng.choice([1, 1, 2])
    df = spark.createDataFrame(rows, INTERVAL.replace("in_date", "index_code string, in_date", 1))
    wanted = [D(2026, 1, 1) + timedelta(days=d) for d in range(-3, 90) if d % 7 < 5]
    dates = spark.createDataFrame([(d,) for d in wanted], "d date")
    every = {(r.trade_date, r.index_code, r.entity) for r in asof.intervals_on_dates(df, dates).collect() if r.entity is not None}
    counts = asof.active_counts(df, ["index_code"], "entity", dates, "n").collect()
    assert {(r.trade_date, r.index_code): r.n for r in counts} == Counter((d, i) for d, i, _ in every)
    total = asof.active_counts(df, [], "entity", dates, "n").collect()
    assert {r.trade_date: r.n for r in total} == Counter(d for d, _ in {(d, e) for d, _, e in every})
    active = [(r.trade_date, r.entity) for r in asof.active_on_dates(df, ["entity"], dates).collect()]
    assert len(active) == len(set(active)) and set(active) == {(d, e) for d, _, e in every}
    assert asof.active_counts(df.limit(0), ["index_code"], "entity", dates, "n").count() == 0
