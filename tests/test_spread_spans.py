"""Spans are spread over tasks before they become rows."""

from datetime import date, timedelta

from tidemark.operators import asof
from tidemark.operators import universe as un

DAYS = [date(2020, 1, 6) + timedelta(7 * i) for i in range(200)]
INTERVALS = "entity long, in_date date, in_effective date, out_date date, out_effective date"


def dates_of(spark):
    return spark.createDataFrame([(d,) for d in DAYS], "trade_date date")


def spread(df):
    """Lines of the plan that deal rows out right below the step that makes rows of spans; adaptive execution leaves them as they are."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "Generate explode(sequence(_first" in line)
    return [line for line in lines[at + 1 : at + 3] if "Repartition" in line]


def test_few_spans_with_many_dates_are_spread_over_tasks(spark):
    held = spark.createDataFrame([(e, DAYS[0], None, None, None) for e in range(400)], INTERVALS).coalesce(1)
    keys = asof.active_on_dates(held, ["entity"], dates_of(spark))
    rows = asof.intervals_on_dates(held, dates_of(spark))
    assert spread(keys) and "[entity" in spread(keys)[0] and spread(rows)
    assert keys.count() == keys.distinct().count() == rows.count() == 400 * len(DAYS)


def test_intervals_of_one_entity_are_spread_too(spark):
    held = spark.createDataFrame([(7, DAYS[0], None, None, None)] * 400, INTERVALS).coalesce(1)
    rows = asof.intervals_on_dates(held, dates_of(spark))
    assert spread(rows) and "[entity" not in spread(rows)[0] and rows.count() == 400 * len(DAYS)


def test_the_first_source_of_a_date_is_found_without_its_entities(spark):
    a = spark.createDataFrame([(DAYS[0], 1), (DAYS[0], 1), (DAYS[1], None), (None, 4)], "trade_date date, entity long")
    b = spark.createDataFrame([(DAYS[0], 2), (DAYS[1], 2), (DAYS[2], 3), (DAYS[2], 3)], "trade_date date, entity long")
    out = un.first_available([("a", a), ("b", b)])
    got = sorted(((r.trade_date, r.entity, r.universe_source) for r in out.collect()), key=str)
    assert got == sorted([(DAYS[0], 1, "a"), (DAYS[1], None, "a"), (DAYS[2], 3, "b")], key=str)
    # The distinct entities of a source are made once: one aggregation per source in the rows, none in the dates.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [trade_date") == 2 + 1
