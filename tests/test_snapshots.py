"""Versions of file tables: stops between any two steps, second writers, and how little an append reads."""

import random
from datetime import date, timedelta

import pytest

from tidemark.session import shared_dir
from tidemark.sources import snapshots as sn
from tidemark.sources import writers as wr

SCHEMA = "k long, d date, v double"
FACTORS = "entity long, trade_date date, factor_name string, factor_value double, as_of_date date, source_run_id string"
DAY = date(2026, 1, 5)


@pytest.fixture
def path(spark):
    return f"{shared_dir(spark)}/snap-{random.random()}"


def frame(spark, keys, day=DAY, value=1.0):
    return spark.createDataFrame([(k, day, value) for k in keys], SCHEMA)


def rows(spark, path):
    return sorted((r.k, r.v) for r in sn.read(spark, path, SCHEMA).collect())


def factors(spark, entities, day=DAY, run="a", value=1.0):
    return spark.createDataFrame([(e, day, "return_20d", value, day, run) for e in entities], FACTORS)


@pytest.mark.parametrize("step", ["write_group", "key_filter", "publish", "_rename_once"])
def test_a_stop_leaves_the_old_table(spark, path, monkeypatch, step):
    def stop(*_, **__):
        raise KeyboardInterrupt

    monkeypatch.setattr(sn, step, stop)
    with pytest.raises(KeyboardInterrupt):
        sn.replace(frame(spark, [1]), path, ["d"], ["k"])
    monkeypatch.undo()
    assert rows(spark, path) == [] and not sn.exists(spark, path)
    sn.replace(frame(spark, [1, 2]), path, ["d"], ["k"])
    monkeypatch.setattr(sn, step, stop)
    with pytest.raises(KeyboardInterrupt):
        sn.replace(frame(spark, [3], value=2.0), path, ["d"], ["k"])
    assert rows(spark, path) == [(1, 1.0), (2, 1.0)]
    monkeypatch.undo()
    sn.replace(frame(spark, [3], value=2.0), path, ["d"], ["k"])
    assert rows(spark, path) == [(3, 2.0)]
    # Nothing is lost for those who read the version before, until it expires.
    assert sn.current(spark, path, 1).read(spark, SCHEMA).count() == 2
    assert sn.expire(spark, path) and rows(spark, path) == [(3, 2.0)]


def test_the_second_of_two_writers_is_told(spark, path):
    base = sn.replace(frame(spark, [1]), path)
    sn.add(frame(spark, [2]), base)
    with pytest.raises(sn.Conflict):
        sn.add(frame(spark, [3]), base)
    assert rows(spark, path) == [(1, 1.0), (2, 1.0)]


def test_replaced_range_rewrites_only_its_groups(spark, path):
    base = sn.replace(frame(spark, [1, 2]), path, ["d"])
    base = sn.add(frame(spark, [3, 4], DAY + timedelta(7)), base, ["d"])
    wr.replace_range_at(spark, path, frame(spark, [9], DAY + timedelta(8), 5.0), f"d > DATE'{DAY}' OR NULL")
    after = sn.current(spark, path)
    assert rows(spark, path) == [(1, 1.0), (2, 1.0), (9, 5.0)] and base.groups[0] in after.groups and len(after.groups) == 2
    # A range may become empty, and so may the table.
    wr.replace_range_at(spark, path, frame(spark, []), f"d > DATE'{DAY}'")
    assert rows(spark, path) == [(1, 1.0), (2, 1.0)]
    wr.replace_range_at(spark, path, frame(spark, []), "true")
    assert rows(spark, path) == [] and sn.current(spark, path).groups == ()


def test_key_filters_have_no_false_negative_and_few_positives(spark, path):
    have = list(range(0, 20_000, 2))
    base = sn.replace(frame(spark, have), path, ["d"], ["k", "d"])
    found = sn.possible(spark, base, frame(spark, range(20_000)), ["k", "d"])
    kept = {r.k for r in found.collect()}
    assert set(have) <= kept and len(kept) - len(have) < 0.02 * 10_000
    assert sn.possible(spark, base, frame(spark, have, DAY + timedelta(1)), ["k", "d"]).count() == 0
    assert {r.k for r in sn.stored_keys(spark, base, frame(spark, [1, 2, 3, 4]), ["k", "d"], SCHEMA).collect()} == {2, 4}


def test_append_reads_few_keys_and_duplicates_stop_it(spark, path, monkeypatch):
    n, days = 200, 5
    for i in range(days):
        wr.append_factor_rows(None, factors(spark, range(n), DAY + timedelta(i)), path)
    read = []
    whole = sn.Snapshot.read
    monkeypatch.setattr(sn.Snapshot, "read", lambda self, s, schema, groups=None: (read.append([g.rows for g in (self.groups if groups is None else groups)]), whole(self, s, schema, groups))[1])
    # A new day: no group's bounds admit it.  New entities among old ones on an old day: the filter of that day alone.
    wr.append_factor_rows(None, factors(spark, range(40), DAY + timedelta(days)), path)
    wr.append_factor_rows(None, factors(spark, range(40), DAY, run="b"), path)
    assert sum(map(sum, read)) < 0.05 * n * days
    taken = factors(spark, [7, 900], DAY + timedelta(3))
    read.clear()
    before = sn.versions(spark, path)
    with pytest.raises(ValueError):
        wr.append_factor_rows(None, taken, path)
    # The exact join reads the one group that holds the key.
    assert [len(x) for x in read] == [1]
    with pytest.raises(ValueError):
        wr.append_factor_rows(None, factors(spark, [5000, 5000]), path)
    assert sn.versions(spark, path) == before


def test_replaced_scope_keeps_other_runs(spark, path):
    wr.append_factor_rows(None, factors(spark, [1, 2], run="a"), path)
    wr.append_factor_rows(None, factors(spark, [1, 2], run="b"), path)
    kept = sn.current(spark, path).groups[0]
    wr.replace_factor_scope_at(factors(spark, [2], run="b", value=7.0), path)
    assert kept in sn.current(spark, path).groups
    got = sorted((r.source_run_id, r.entity, r.factor_value) for r in sn.read(spark, path, FACTORS).collect())
    assert got == [("a", 1, 1.0), ("a", 2, 1.0), ("b", 2, 7.0)]
