"""Calendar lookups outside and at the ends of the open days, portfolio curves, fingerprints of many names."""

from datetime import date

import pytest

from tidemark.functions import calendar as cal
from tidemark.operators import asof, quality, reports, runlog, selection
from tidemark.operators import portfolio as pf
from tidemark.operators.validation import forward_labels
from tidemark.session import clean_up, materialize, shared_dir, stored
from tidemark.sources import prepare, writers

DAYS = [date(1949, 12, 30), date(1950, 1, 3), date(1950, 1, 4), date(1950, 1, 5), date(2101, 3, 1)]


def calendar(spark, days=DAYS):
    return spark.createDataFrame([(d, True) for d in days], "trade_date date, is_open boolean")


def test_targets_before_1950_and_after_2100(spark):
    days = calendar(spark)
    got = {r.trade_date: r.target_date for r in cal.target_dates(days, [1], days).collect()}
    assert got == dict(zip(DAYS, DAYS[1:]))


def test_neighbours_outside_the_calendar(spark):
    asked = [date(1900, 1, 1), DAYS[0], date(1950, 1, 10), date(2101, 3, 1), date(2500, 1, 1), None]
    facts = spark.createDataFrame([(i, d) for i, d in enumerate(asked)], "i int, d date")
    got = {r.i: r.n for r in cal.next_open(facts, "d", calendar(spark), "n").collect()}
    assert got == {0: DAYS[0], 1: DAYS[1], 2: DAYS[4], 3: None, 4: None, 5: None}
    assert cal.next_open(facts, "d", calendar(spark).limit(0), "n").filter("n IS NOT NULL").count() == 0
    issues = cal.unplaced(cal.next_open(facts, "d", calendar(spark), "n"), "facts", "d", "n").collect()
    assert [(r.dataset, r.row_count) for r in issues] == [("facts", 2)]


def test_labels_keep_early_rows(spark):
    rows = [(1, d, float(i + 1), None) for i, d in enumerate(DAYS)]
    prices = spark.createDataFrame(rows, "entity int, trade_date date, close double, adj_factor double")
    got = {r.trade_date: r.forward_return for r in forward_labels(prices, calendar(spark), [1]).collect()}
    assert got == pytest.approx({DAYS[i]: 1 / (i + 1) for i in range(4)})


def test_open_intervals_reach_the_last_date(spark):
    rows = [(1, date(1900, 1, 1), None), (2, date(1950, 1, 4), date(1950, 1, 5)), (3, date(2101, 3, 1), None), (4, date(2200, 1, 1), None)]
    df = spark.createDataFrame(rows, "entity int, a date, b date")
    got = {(r.entity, r.trade_date) for r in asof.on_dates(df, "a", "b", calendar(spark).select("trade_date")).collect()}
    assert got == {(1, d) for d in DAYS} | {(2, DAYS[2]), (3, DAYS[4])}


def test_nav_of_total_and_larger_losses(spark):
    def nav(returns):
        rows = [(date(2000, 1, i + 1), r) for i, r in enumerate(returns)]
        df = spark.createDataFrame(rows, "trade_date date, portfolio_return double")
        return [r.nav for r in pf.with_nav(df).orderBy("trade_date").collect()]

    assert nav([0.0, -1.0, 0.1]) == pytest.approx([1, 0, 0])
    assert nav([0.5, -1.5, -3.0, None]) == pytest.approx([1.5, -0.75, 1.5, 1.5])


def test_empty_selection_sells_out(spark):
    opens = [date(2000, m, d) for m in (1, 2, 3, 4) for d in (3, 28)]
    targets = spark.createDataFrame([(1, date(2000, 1, 28), 1.0), (1, date(2000, 3, 28), 1.0)], "entity int, signal_date date, target_weight double")
    signals = spark.createDataFrame([(date(2000, m, 28),) for m in (1, 2, 3)], "signal_date date")
    days = calendar(spark, opens)
    rows = {(r.execution_date.month, r.side) for r in pf.orders(targets, days, 1.0, signals).collect()}
    assert rows == {(2, "buy"), (3, "sell"), (4, "buy")}
    held = {r.trade_date for r in pf.holdings(targets, days, signals).collect()}
    assert held == {date(2000, 2, 3), date(2000, 2, 28), date(2000, 4, 3), date(2000, 4, 28)}


def test_all_names_and_keys_count(spark):
    def table(last):
        return spark.createDataFrame([(f"s{i:02d}",) for i in range(24)] + [(last,)], "source string")

    a, b = (runlog.table_fingerprint(table(x), "t").first().fingerprint for x in ("x", "y"))
    assert a != b and quality.source_names(table("x"), "t").count() == 25
    keys = spark.range(30).selectExpr("id div 2 AS k")
    assert quality.duplicate_keys(keys, ["k"]).count() == 15 and quality.duplicate_keys(keys, ["k"], 5).count() == 5
    ranked = spark.range(40).selectExpr("id AS entity", "id AS rank")
    assert reports.rank_changes(ranked, ranked.limit(0)).count() == 40


def test_explicit_failures(spark):
    rows = [("r", 1, date(2000, 1, 1), "f", 1.0, date(2000, 1, 1)), ("r", 1, date(2000, 1, 1), "f", 2.0, date(2000, 1, 1))]
    store = spark.createDataFrame(rows, "source_run_id string, entity int, trade_date date, factor_name string, factor_value double, as_of_date date")
    with pytest.raises(Exception, match="several rows"):
        selection.latest_versions(store, "2000-02-01").collect()
    assert selection.repeated_versions(store).count() == 1
    with pytest.raises(ValueError, match="duplicate"):
        writers.append_factor_rows(None, store, f"{shared_dir(spark)}/never")
    members = spark.createDataFrame([("t", "X", 1, date(2000, 1, 1), None), ("t", "X", 1, date(2000, 2, 1), None)], "source_tag string, index_code string, entity int, in_effective date, out_effective date")
    with pytest.raises(ValueError, match="overlapping"):
        prepare.import_members(members.limit(0), members, overwrite=True)


def test_stored_tables_are_built_once_and_cleaned_up(spark):
    calls = []
    build = lambda: calls.append(1) or spark.range(10).withColumnRenamed("id", "entity")
    assert stored(spark, "test-key", build, "entity").count() == stored(spark, "test-key", build, "entity").count() == 10
    assert calls == [1]
    before = shared_dir(spark)
    materialize(spark.range(3))
    clean_up(spark)
    assert shared_dir(spark) != before
    assert stored(spark, "test-key", build).count() == 10 and len(calls) == 2
