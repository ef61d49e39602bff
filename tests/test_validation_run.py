"""A validation run: ranks and groups of all horizons in one pass, computed once for all frames."""

from datetime import date, timedelta

import pytest

from tidemark.operators import validation as va

DAYS = [date(2020, 1, 6) + timedelta(d) for d in range(6)]
H = [1, 2, 9]


def _labelled(spark):
    """Ties in values and returns, returns that lack for some horizons, NaN, a constant factor, one without direction and rows that come twice."""
    rows = []
    for day in DAYS[:3]:
        for e in range(23):
            short = None if e % 5 == 0 else float((e * 7 + day.day) % 6) - 2
            long = None if e % 7 == 1 else float((e * 11) % 13) / 3
            if short is None and long is None:
                continue
            values = {"return_20d": float(e % 9) - 4, "volatility_20d": float(e * 5 % 17) if e % 10 < 9 else float("nan"), "is_st": float(e % 2), "pb_percentile": 0.5}
            for name, value in values.items():
                rows += [(e, name, day, value, short, long, None)] * (2 if e == 3 else 1)
    rows += [(e, "return_60d", DAYS[4], float(e), float(-e), None, None) for e in range(2)]
    return spark.createDataFrame(
        rows, "entity BIGINT, factor_name STRING, trade_date DATE, factor_value DOUBLE, return_1 DOUBLE, return_2 DOUBLE, return_9 DOUBLE"
    )


def _by_key(df):
    rows = [r.asDict() for r in df.collect()]
    out = {tuple(r.pop(k) for k in va.CROSS_SECTION): r for r in rows}
    assert len(out) == len(rows)
    return out


def _near(found):
    return {key: pytest.approx(row, abs=1e-12) for key, row in found.items()}


@pytest.mark.parametrize("slice_rows", [250_000, 5])
@pytest.mark.parametrize("min_group_size", [1, 6])
def test_one_pass_gives_the_ranks_and_groups_of_each_horizon(spark, monkeypatch, slice_rows, min_group_size):
    monkeypatch.setattr(va, "SLICE_ROWS", slice_rows)
    wide = _labelled(spark)
    long = va.by_horizon(wide, H, ["entity", "factor_name", "trade_date", "factor_value"])
    ic, groups = va.cross_sections(wide, H, 4, 3, min_group_size)
    want_ic, want_groups = va.rank_ic(long, 3), va.group_returns(long, 4, min_group_size)
    assert ic.columns == want_ic.columns and groups.columns == want_groups.columns
    found, grouped = _by_key(ic), _by_key(groups)
    assert found == _near(_by_key(want_ic)) and grouped == _near(_by_key(want_groups))
    assert {h for _, _, h in found} == {1, 2} and found[("return_60d", DAYS[4], 1)]["rank_ic"] is None
    assert found[("is_st", DAYS[0], 1)]["rank_ic"] is not None and found[("is_st", DAYS[0], 1)]["oriented_rank_ic"] is None
    assert {name for name, _, _ in grouped} <= {"return_20d", "volatility_20d", "pb_percentile"}


def _run(spark):
    prices = [(e, d, 10.0 + (e * 3 + i * i) % 7, None) for e in range(12) for i, d in enumerate(DAYS) if (e + i) % 6]
    prices.append((3, DAYS[3], 0.0, None))
    values = [(e, d, d, "return_20d", float((e * 5 + d.day) % 8)) for e in range(12) for d in DAYS]
    return va.validate(
        spark.createDataFrame(values, "entity BIGINT, trade_date DATE, as_of_date DATE, factor_name STRING, factor_value DOUBLE"),
        spark.createDataFrame(prices, "entity BIGINT, trade_date DATE, close DOUBLE, adj_factor DOUBLE"),
        spark.createDataFrame([(d, True) for d in DAYS], "trade_date DATE, is_open BOOLEAN"),
        spark.createDataFrame([(e, d) for e in range(12) for d in DAYS], "entity BIGINT, trade_date DATE"),
        ["return_20d"], [1, 2], 4, 3,
    )


def test_frames_of_a_run_read_written_ranks_and_groups(spark):
    frames = _run(spark)
    for name in ("rank_ic", "ic_summary", "group_returns", "decay_curve", "yearly_ic_summary"):
        assert "Window" not in frames[name]._jdf.queryExecution().executedPlan().toString(), name
    assert frames["rank_ic"].count() == 9 and frames["ic_summary"].count() == 2 and frames["yearly_ic_summary"].count() == 2


def test_labels_of_a_run_are_counted_per_horizon(spark):
    frames = _run(spark)
    counted = {r.horizon: r.valid_label_count for r in frames["label_summary"].collect()}
    ranked = {}
    for r in frames["rank_ic"].collect():
        ranked[r.horizon] = ranked.get(r.horizon, 0) + r.valid_n
    assert counted == ranked and set(counted) == {1, 2}
