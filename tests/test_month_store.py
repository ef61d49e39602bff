"""The month store holds base columns only; the others are computed on reading."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from tidemark.sources.history import stored_history

DAYS = [date(2020, 1, 6) + timedelta(7 * i) for i in range(20)]


def test_the_month_store_holds_base_columns(spark):
    kept = {}

    def store(name, build, **_):
        kept[name] = build()
        return kept[name]

    base = spark.createDataFrame([(e, d, 1.0 + e, 2.0) for e in range(3) for d in DAYS], "entity long, trade_date date, close double, avg_qty double")
    columns = ["entity", "trade_date", "close", "CASE WHEN entity = 1 THEN -close ELSE close END AS pe_ttm", "avg_qty / 10 AS pb"]
    history = stored_history(base, {"rows": "true", "pe_ttm": "pe_ttm > 0", "pb": "pb > 0"}, store, columns)
    assert kept["history_rows"].columns == ["entity", "trade_date", "close", "avg_qty", "month"]
    assert history.rows.columns == ["entity", "trade_date", "close", "pe_ttm", "pb", "month"]
    counted = history.counts.groupBy("entity").agg(F.sum("rows"), F.sum("pe_ttm"), F.sum("pb")).collect()
    assert sorted(tuple(r) for r in counted) == [(0, 20, 20, 20), (1, 20, 0, 20), (2, 20, 20, 20)]
