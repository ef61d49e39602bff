"""Stored key tables whose files are as large as their rows."""

from tidemark.session import materialize


def test_plain_keys_do_not_pass_for_a_small_table(spark):
    keys = spark.range(1_000_000).selectExpr("id div 100 AS entity", "date_add(DATE'2000-01-03', CAST(id % 100 AS INT)) AS trade_date").repartition(2, "entity").sortWithinPartitions("entity")
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    plain = materialize(keys, plain=True)
    assert size(plain) >= 12_000_000 > 4 * size(materialize(keys))
    assert plain.exceptAll(keys).isEmpty() and plain.count() == 1_000_000
