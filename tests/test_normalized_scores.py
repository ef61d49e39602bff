"""Percentile scores are the same by plain windows and by slices, and the windows need one shuffle."""

from datetime import date

from tidemark.operators import scoring as sc

DAYS = [date(2020, 1, 6), date(2020, 2, 3), date(2020, 3, 2)]


def rows(spark):
    values = [(e, DAYS[0], "return_20d", float(e % 5) - 2) for e in range(40)]
    values += [(e, DAYS[0], "pb_percentile", v) for e, v in enumerate([0.0, -0.0, 1.5, 0.0, None, 3.0, 1.5])]
    values += [(e, DAYS[1], "pb_percentile", 2.0) for e in range(4)] + [(9, DAYS[2], "return_20d", 7.0)]
    values += [(3, DAYS[0], "return_20d", 1.0), (None, DAYS[0], "return_20d", 1.0)]
    return spark.createDataFrame(values, "entity long, trade_date date, factor_name string, factor_value double")


def test_small_groups_score_as_sliced_ones(spark):
    df = rows(spark)
    plain = sc.normalized_scores(df, largest=100)
    sliced = sc.normalized_scores(df)
    assert plain.schema.simpleString() == sliced.schema.simpleString()
    got = sorted((tuple(r) for r in plain.collect()), key=str)
    assert got == sorted((tuple(r) for r in sliced.collect()), key=str) and len(got) == df.count() - 1
    by_rank = {r.entity: r.normalized_score for r in plain.collect() if r.factor_name == "pb_percentile" and r.trade_date == DAYS[0]}
    # Lower is better: 3.0 is last, the three zeros share the top.
    assert by_rank[5] == 0.0 and by_rank[0] == by_rank[1] == by_rank[3] == 80.0


def test_small_groups_meet_no_table_of_values(spark):
    plan = sc.normalized_scores(rows(spark), largest=100)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
