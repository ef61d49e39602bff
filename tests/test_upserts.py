"""Bucketed upserts: replayed batches, rewritten buckets, conflicts, stops; digests: only new groups are read."""

import random

import pytest

from tidemark.operators import runlog as rl
from tidemark.session import shared_dir
from tidemark.sources import digests, upserts
from tidemark.sources import snapshots as sn

SCHEMA = "tag string, id long, h string, note string"
KEY = ["tag", "id"]


@pytest.fixture
def path(spark):
    return f"{shared_dir(spark)}/upsert-{random.random()}"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(spark, path):
    return sorted((tuple(r) for r in sn.read(spark, path, SCHEMA).collect()), key=str)


def put(spark, path, data, **options):
    return upserts.upsert_at(frame(spark, data), path, KEY, "h", buckets=8, **options)


BASE = [("a" if i % 3 else None, i, f"h{i}", "old") for i in range(100)]


def test_a_batch_is_applied_once(spark, path):
    assert put(spark, path, BASE, stream="s", batch=3) == {"inserted": 100}
    one = sn.current(spark, path)
    assert put(spark, path, [("a", 1, "x", "new")], overwrite=True, stream="s", batch=3) is None
    assert put(spark, path, [("a", 1, "x", "new")], overwrite=True, stream="s", batch=2) is None
    assert sn.current(spark, path) == one and rows(spark, path) == sorted(BASE, key=str)
    # Streams are counted apart; rows that are known already change no bucket.
    assert put(spark, path, BASE, stream="t", batch=0) == {"skipped": 100}
    two = sn.current(spark, path)
    assert two.groups == one.groups and two.batches == {"s": 3, "t": 0}
    assert put(spark, path, BASE) == {"skipped": 100} and sn.current(spark, path) == two


def test_one_key_rewrites_one_bucket(spark, path):
    put(spark, path, BASE)
    before = {g.bucket: g for g in sn.current(spark, path).groups}
    assert set(before) == set(range(8)) and sum(g.rows for g in before.values()) == 100
    assert put(spark, path, [(None, 3, "x", "new")], overwrite=True) == {"overwritten": 1}
    after = {g.bucket: g for g in sn.current(spark, path).groups}
    assert sum(after[b] != before[b] for b in before) == 1
    assert rows(spark, path) == sorted([r if r[1] != 3 else (None, 3, "x", "new") for r in BASE], key=str)
    # Expiry deletes the replaced bucket and no other.
    assert len(sn.expire(spark, path)) == 1 and len(rows(spark, path)) == 100


def test_conflicts_write_nothing(spark, path):
    put(spark, path, BASE)
    before = sn.current(spark, path)
    for bad in ([("a", 1, "x", "new"), ("a", 500, "y", "new")], [("b", 1, "x", "n"), ("b", 1, "y", "n")], [("b", 1, None, "n"), ("b", 1, "y", "n")]):
        with pytest.raises(upserts.KeyConflict):
            put(spark, path, bad, stream="s", batch=0)
    assert sn.current(spark, path) == before
    # Repeated rows count once; null keys and null hashes are values.
    assert put(spark, path, [("b", None, None, "n"), ("b", None, None, "m")]) == {"inserted": 1}
    assert put(spark, path, [("b", None, None, "z")]) == {"skipped": 1}
    assert ("b", None, None, "m") in rows(spark, path) and put(spark, path, []) == {}


@pytest.mark.parametrize("step", ["write_buckets", "publish", "_rename_once"])
def test_a_stopped_batch_can_be_sent_again(spark, path, monkeypatch, step):
    def stop(*_, **__):
        raise KeyboardInterrupt

    put(spark, path, BASE, stream="s", batch=0)
    monkeypatch.setattr(sn, step, stop)
    with pytest.raises(KeyboardInterrupt):
        put(spark, path, [("c", 1, "x", "new")], stream="s", batch=1)
    monkeypatch.undo()
    assert rows(spark, path) == sorted(BASE, key=str)
    assert put(spark, path, [("c", 1, "x", "new")], stream="s", batch=1) == {"inserted": 1}
    assert len(rows(spark, path)) == 101


FACTS = "trade_date date, publish_time timestamp, source string, source_tag string, v long"


def facts(spark, n, source):
    return spark.range(n).selectExpr(
        "date_add(DATE'2020-01-01', CAST(id AS INT)) AS trade_date", "CAST(NULL AS TIMESTAMP) AS publish_time",
        f"{source} AS source", "CAST(id % 2 AS STRING) AS source_tag", "id AS v",
    )


def test_fingerprint_after_an_append_reads_new_groups_only(spark, path, monkeypatch):
    read = []
    whole = sn.Snapshot.read
    monkeypatch.setattr(sn.Snapshot, "read", lambda self, s, schema, groups=None: read.append([g.name for g in groups or self.groups]) or whole(self, s, schema, groups))
    assert rl.stored_fingerprint(spark, path, FACTS, "t").collect() == rl.table_fingerprint(spark.createDataFrame([], FACTS), "t").collect()
    parts = [facts(spark, 50, "'x'"), facts(spark, 9, "CASE WHEN id > 3 THEN 'x' WHEN id > 1 THEN 'y' END"), facts(spark, 70, "CAST(NULL AS STRING)")]
    total = None
    for part in parts:
        total = part if total is None else total.unionByName(part)
        now = sn.add(part, sn.current(spark, path))
        read.clear()
        got = rl.stored_fingerprint(spark, path, FACTS, "t").collect()
        assert read == [[now.groups[-1].name]]
        assert got == rl.table_fingerprint(total, "t").collect()
    # Dropped groups leave the fingerprint without a read of the others.
    base = sn.current(spark, path)
    sn.publish(spark, base, base.groups[1:])
    read.clear()
    assert rl.stored_fingerprint(spark, path, FACTS, "t").collect() == rl.table_fingerprint(parts[1].unionByName(parts[2]), "t").collect()
    assert read == []


def test_digests_survive_stops_and_buckets(spark, path):
    for batch in range(2):
        put(spark, path, [(f"t{i % 3}", i + 10 * batch, "h", "n") for i in range(20)], overwrite=True, stream="s", batch=batch)
    now = sn.current(spark, path)
    digests.digest(now.read(spark, SCHEMA, now.groups[:2]).selectExpr("tag", sn.GROUP_OF_ROW), [], ["tag"]).write.parquet(f"{path}/digests/stopped")
    at, files = sn.file_system(spark, f"{path}/digests/stopped/_SUCCESS")
    files.delete(at, False)
    assert set(digests.refresh(spark, now, SCHEMA, [], ["tag"])) == {g.name for g in now.groups}
    assert digests.refresh(spark, now, SCHEMA, [], ["tag"]) == []
    found = digests.merged(spark, now).collect()
    assert sum(r.row_count for r in found if r.name == "") == len(rows(spark, path))
    assert {r.member for r in found if r.name == "tag"} == {"t0", "t1", "t2"}
