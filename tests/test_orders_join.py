"""Small files of many orders are not broadcast."""

from tidemark.plans.views import Tables
from tidemark.schemas import INPUT_SCHEMAS


def test_orders_meet_their_entities_without_a_broadcast(spark, tmp_path):
    orders = [(k, k % 7, "O", 1.0, None, "1-URGENT") for k in range(300)]
    lines = [(k % 250, 1, k % 11, 1, 1.0, 1.0, 0.0, 0.0, "N", "O", None) for k in range(900)]
    for name, rows in (("orders", orders), ("lineitem", lines)):
        spark.createDataFrame(rows, INPUT_SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    joined = Tables(spark, str(tmp_path))._orders_with_entities()
    held = {}
    for k, *_ in lines:
        held.setdefault(k, [])
    for line in lines:
        held[line[0]].append(line[2])
    assert {r.o_orderkey: (r.first_entity, r.last_entity) for r in joined.collect()} == {k: (min(v), max(v)) for k, v in held.items()}
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
