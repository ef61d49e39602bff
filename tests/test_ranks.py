"""Sliced order statistics against brute force, with tiny slices and hot groups."""

import random

import numpy as np
import pandas as pd
import pytest

from tidemark.functions import ranks


@pytest.fixture(scope="module")
def frame():
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        group = "hot" if i % 3 else f"g{i % 50}"
        # A third of the hot group shares one value.
        value = 0.0 if rnd.random() < 0.34 else round(rnd.gauss(0, 5), 2)
        rows.append((group, i, value))
    return pd.DataFrame(rows, columns=["g", "id", "v"])


@pytest.mark.parametrize("slice_rows", [5, 40, 10**9])
def test_average_rank_matches_pandas(spark, frame, slice_rows):
    df = spark.createDataFrame(frame)
    got = ranks.with_average_rank(df, ["g"], "v", "r", "n", slice_rows=slice_rows).toPandas().sort_values("id")
    want = frame.groupby("g")["v"].rank(method="average")
    assert np.allclose(got["r"].to_numpy(), want.to_numpy())
    assert (got["n"].to_numpy() == frame.groupby("g")["v"].transform("count").to_numpy()).all()


@pytest.mark.parametrize("slice_rows", [5, 10**9])
def test_row_numbers_with_ties_broken_by_id(spark, frame, slice_rows):
    df = spark.createDataFrame(frame)
    got = ranks.row_numbers(df, ["g"], ["v", "id"], slice_rows=slice_rows).toPandas().set_index("id")["rank"]
    want = frame.sort_values(["g", "v", "id"]).assign(r=lambda x: x.groupby("g").cumcount() + 1).set_index("id")["r"]
    assert (got.sort_index() == want.sort_index()).all()


@pytest.mark.parametrize("slice_rows", [7, 10**9])
def test_quantiles_match_pandas(spark, frame, slice_rows):
    df = spark.createDataFrame(frame)
    got = ranks.quantiles(df, ["g"], "v", {"q25": 0.25, "med": 0.5, "q75": 0.75}, slice_rows).toPandas().set_index("g")
    by = frame.groupby("g")["v"]
    for name, q in (("q25", 0.25), ("med", 0.5), ("q75", 0.75)):
        assert np.allclose(got[name].sort_index(), by.quantile(q).sort_index())


@pytest.mark.parametrize("largest", [None, 10**6])
def test_quantiles_of_several_columns_match_pandas(spark, frame, largest):
    frame = frame.assign(w=frame["v"].where(frame["v"] > frame["v"].median()) * 3)
    points = {"v": {"med": 0.5}, "w": {"w10": 0.1, "w50": 0.5}}
    rows = [(r.g, None if np.isnan(r.v) else r.v, None if np.isnan(r.w) else r.w) for r in frame.itertuples()]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    got = ranks.several_quantiles(df, ["g"], points, 7, largest).toPandas().set_index("g").sort_index()
    by = frame.astype({"g": str}).groupby("g")
    for column, name, q in (("v", "med", 0.5), ("w", "w10", 0.1), ("w", "w50", 0.5)):
        assert np.allclose(got[name], by[column].quantile(q).sort_index(), equal_nan=True)


def test_first_per_key_puts_nulls_last_and_sorts_down(spark):
    df = spark.createDataFrame(
        [("a", None, 1, "x"), ("a", 5, 2, "y"), ("a", 5, 1, "z"), ("b", None, 9, "w")], "k string, n int, m int, tag string"
    )
    got = {r.k: r.tag for r in ranks.first_per_key(df, ["k"], ["n", "m DESC"]).collect()}
    assert got == {"a": "y", "b": "w"}


def test_single_group_larger_than_slices_keeps_every_row(spark):
    df = spark.range(20000).selectExpr("'one' AS g", "id", "CAST(id % 997 AS DOUBLE) AS v")
    out = ranks.row_numbers(df, ["g"], ["v", "id"], slice_rows=100)
    check = out.selectExpr("count(*) AS n", "count(DISTINCT rank) AS d", "min(rank) AS lo", "max(rank) AS hi").first()
    assert tuple(check) == (20000, 20000, 1, 20000)


def test_small_groups_take_plain_windows(spark, frame):
    df = spark.createDataFrame(frame)
    largest = ranks.largest_group(df, ["g"])
    assert largest == frame.groupby("g").size().max()
    for name in ("with_average_rank", "row_numbers"):
        args = (["g"], "v", "r", "n") if name == "with_average_rank" else (["g"], ["v", "id"], "r", "n")
        sliced = getattr(ranks, name)(df, *args, slice_rows=40).toPandas().sort_values("id")
        plain = getattr(ranks, name)(df, *args, largest=largest).toPandas().sort_values("id")
        assert np.allclose(sliced["r"].to_numpy(dtype=float), plain["r"].to_numpy(dtype=float))
        assert (sliced["n"].to_numpy() == plain["n"].to_numpy()).all()
    empty = spark.createDataFrame([("a", 1, None), ("a", 2, 3.0)], "g string, id int, v double")
    got = ranks.with_average_rank(empty, ["g"], "v", "r", "n", largest=2).orderBy("id").collect()
    assert [(r.r, r.n) for r in got] == [(None, None), (1.0, 1)]
