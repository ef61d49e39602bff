"""Factor validation against forward returns, for all dates at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import day_key, dense_days, open_days
from tidemark.functions.ranks import SLICE_ROWS, correlation, largest_group, row_numbers, with_average_rank
from tidemark.operators.factors import ADJUSTED_CLOSE
from tidemark.params import FACTORS

CROSS_SECTION = ["factor_name", "trade_date", "horizon"]


def metadata(spark) -> DataFrame:
    """``factor_name, factor_type, direction, score_group`` (a fixed, small table)."""
    rows = [(name, *spec) for name, spec in FACTORS.items()]
    return spark.createDataFrame(rows, "factor_name STRING, factor_type STRING, direction STRING, score_group STRING")


def direction_sign(column: str = "factor_name") -> str:
    """SQL: +1, -1 or NULL by the factor's direction."""
    up = ", ".join(f"'{n}'" for n, spec in FACTORS.items() if spec[1] == "higher_is_better")
    down = ", ".join(f"'{n}'" for n, spec in FACTORS.items() if spec[1] == "lower_is_better")
    return f"CASE WHEN {column} IN ({up}) THEN 1 WHEN {column} IN ({down}) THEN -1 END"


def _return(horizon: int) -> str:
    return f"return_{horizon}"


def forward_returns(prices: DataFrame, calendar: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """``entity, trade_date`` and a column ``return_<h>`` per horizon, close-to-close on adjusted prices; NULL where there is no finite return.

    The price h open days ahead is read with a one-point RANGE frame over the
    calendar position, so labels need the entity shuffle only and no self-join.
    Open day n sits at 2n and a closed day after it at 2n + 1.
    """
    opens = open_days(calendar).selectExpr("trade_date AS open_date")
    days = (
        dense_days(calendar, ["upto"])
        .join(opens, F.expr("day = open_date"), "left")
        .selectExpr("day", "2 * upto + CAST(open_date IS NULL AS INT) AS pos")
    )
    keyed = prices.selectExpr("entity", "trade_date", f"{ADJUSTED_CLOSE} AS adj").withColumn("_key", day_key("trade_date", calendar))
    base = keyed.join(days, F.expr("_key = day")).drop("_key", "day")

    def ahead(n: int) -> str:
        # Positions are even for open days, so a closed day never matches as a target.
        frame = f"OVER (PARTITION BY entity ORDER BY pos RANGE BETWEEN {n} FOLLOWING AND {n} FOLLOWING)"
        return f"max(adj) {frame}"

    targets = [
        f"CASE WHEN pos % 2 = 0 THEN {ahead(2 * h)} ELSE {ahead(2 * h - 1)} END AS adj_{h}" for h in horizons
    ]
    values = [f"try_divide(adj_{h}, adj) - 1 AS {_return(h)}" for h in horizons]
    finite = [f"CASE WHEN abs({_return(h)}) < double('Infinity') THEN {_return(h)} END AS {_return(h)}" for h in horizons]
    return base.selectExpr("entity", "trade_date", "adj", *targets).selectExpr("entity", "trade_date", *values).selectExpr("entity", "trade_date", *finite)


def by_horizon(wide: DataFrame, horizons: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """A row per horizon with a return, from the columns of :func:`forward_returns`."""
    pairs = ", ".join(f"{h}L, {_return(h)}" for h in horizons)
    return wide.selectExpr(*keep, f"stack({len(horizons)}, {pairs}) AS (horizon, forward_return)").filter("forward_return IS NOT NULL")


def forward_labels(prices: DataFrame, calendar: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """``entity, trade_date, horizon, forward_return``, see :func:`forward_returns`."""
    return by_horizon(forward_returns(prices, calendar, horizons), horizons, ["entity", "trade_date"])


def load_factor_values(
    store: DataFrame, start: str, end: str, names: Sequence[str], same_day: bool = True
) -> DataFrame:
    out = store.filter(f"trade_date BETWEEN DATE'{start}' AND DATE'{end}'").filter(
        F.col("factor_name").isin(list(names))
    )
    return out.filter("as_of_date = trade_date") if same_day else out


def with_labels(factor_values: DataFrame, labels: DataFrame) -> DataFrame:
    return factor_values.filter("factor_value IS NOT NULL").join(labels, ["entity", "trade_date"]).select(
        "entity", *CROSS_SECTION, "factor_value", "forward_return"
    )


def coverage(factor_values: DataFrame, universe: DataFrame, dates: DataFrame, names: Sequence[str]) -> DataFrame:
    """Valid against expected entities per factor and date; NULL rates without a universe.

    A universe with a ``universe_source`` column names its source by date, ``missing`` on dates without one.
    """
    valid = (
        factor_values.filter(F.col("factor_name").isin(list(names)))
        .select("factor_name", "trade_date", "entity")
        .distinct()
        .groupBy("factor_name", "trade_date")
        .agg(F.expr("count(*) AS valid_factor_count"))
    )
    named = "universe_source" in universe.columns
    source = ["universe_source"] if named else []
    sizes = universe.select("trade_date", "entity", *source).distinct().groupBy("trade_date").agg(
        F.expr("count(DISTINCT entity) AS universe_count"), *([F.expr("min(universe_source) AS universe_source")] if named else [])
    )
    listed = ", ".join(f"'{n}'" for n in names)
    grid = dates.selectExpr("trade_date", f"explode(array({listed})) AS factor_name")
    return (
        grid.join(sizes, "trade_date", "left")
        .join(valid, ["factor_name", "trade_date"], "left")
        .selectExpr(
            "factor_name",
            "trade_date",
            "coalesce(universe_count, 0) AS universe_count",
            "coalesce(valid_factor_count, 0) AS valid_factor_count",
            *(["coalesce(universe_source, 'missing') AS universe_source"] if named else []),
        )
        .selectExpr(
            "*",
            "greatest(universe_count - valid_factor_count, 0) AS missing_count",
            "try_divide(valid_factor_count, universe_count) AS coverage",
            "1 - try_divide(valid_factor_count, universe_count) AS missing_rate",
        )
    )


def coverage_warnings(covered: DataFrame) -> DataFrame:
    """Dates whose universe does not support formal point-in-time conclusions, by its source."""
    formal = "universe_source LIKE '%historical_pit%' OR universe_source = 'universe_members'"
    return (
        covered.select("trade_date", "universe_source").distinct()
        .filter(f"NOT ({formal})")
        .selectExpr("trade_date", "universe_source", "concat('Coverage universe snapshot for ', trade_date, ' is ', universe_source, "
                    "'; formal historical PIT conclusions are not supported.') AS warning")
    )


def _ic_columns(min_observations: int) -> list:
    """Per cross-section, over the ranks ``_x`` and ``_y``."""
    return [
        F.expr("count(*) AS valid_n"),
        F.expr(f"CASE WHEN count(*) >= {min_observations} THEN {correlation('_x', '_y')} END AS rank_ic"),
    ]


def _oriented(ic: DataFrame) -> DataFrame:
    return ic.selectExpr("*", f"rank_ic * {direction_sign()} AS oriented_rank_ic")


def rank_ic(labelled: DataFrame, min_observations: int) -> DataFrame:
    """Daily Spearman correlation of factor and forward return per cross-section; ``labelled`` is a written table."""
    largest = largest_group(labelled, CROSS_SECTION)
    ranked = with_average_rank(labelled, CROSS_SECTION, "factor_value", "_x", largest=largest)
    ranked = with_average_rank(ranked, CROSS_SECTION, "forward_return", "_y", largest=largest)
    return _oriented(ranked.groupBy(*CROSS_SECTION).agg(*_ic_columns(min_observations)))


def _mean_over_std(column: str) -> str:
    """SQL: mean over sample deviation, NULL below two values or without spread."""
    return (
        f"CASE WHEN count({column}) > 1 AND max({column}) > min({column}) "
        f"THEN try_divide(avg({column}), stddev_samp({column})) END"
    )


def _sample_std(column: str) -> str:
    return f"CASE WHEN count({column}) > 1 THEN stddev_samp({column}) END"


def ic_summary(ic: DataFrame) -> DataFrame:
    aggs = []
    for prefix, column in (("", "rank_ic"), ("oriented_", "oriented_rank_ic")):
        aggs += [
            f"count({column}) AS valid_{prefix}ic_dates",
            f"avg({column}) AS mean_{column}",
            f"{_sample_std(column)} AS {column}_std",
            f"{_mean_over_std(column)} AS {prefix}icir",
        ]
    return ic.groupBy("factor_name", "horizon").agg(*[F.expr(a) for a in aggs])


def _group_columns(bucket: str, n_groups: int) -> list:
    return [
        F.expr(f"avg(CASE WHEN {bucket} = {n_groups - 1} THEN forward_return END) AS top_return"),
        F.expr(f"avg(CASE WHEN {bucket} = 0 THEN forward_return END) AS bottom_return"),
        F.expr(f"least(count_if({bucket} = {n_groups - 1}), count_if({bucket} = 0)) AS valid_group_size"),
    ]


def _spread(groups: DataFrame) -> DataFrame:
    return groups.filter("top_return IS NOT NULL AND bottom_return IS NOT NULL").selectExpr(
        "*",
        "top_return - bottom_return AS top_minus_bottom_return",
        "top_return - bottom_return AS long_short_return",
    )


def group_returns(labelled: DataFrame, n_groups: int, min_group_size: int) -> DataFrame:
    """Mean forward return of the top and bottom of ``n_groups`` ordered buckets."""
    oriented = labelled.selectExpr("*", f"factor_value * {direction_sign()} AS oriented").filter(
        "oriented IS NOT NULL"
    )
    largest = largest_group(labelled, CROSS_SECTION)
    placed = row_numbers(oriented, CROSS_SECTION, ["oriented", "entity"], "rn", "n", largest=largest)
    return _spread(
        placed.filter(f"n >= {n_groups * min_group_size}")
        .selectExpr(*CROSS_SECTION, "forward_return", f"((rn - 1) * {n_groups}) div n AS bucket")
        .filter(f"bucket IN (0, {n_groups - 1})")
        .groupBy(*CROSS_SECTION)
        .agg(*_group_columns("bucket", n_groups))
    )


def cross_sections(
    labelled: DataFrame, horizons: Sequence[int], n_groups: int, min_observations: int, min_group_size: int
) -> tuple[DataFrame, DataFrame]:
    """:func:`rank_ic` and :func:`group_returns` of a written table with the returns of all horizons in a row, each computed once and written.

    Where each cross-section fits into one slice, one shuffle and two sorts serve both: the order by oriented value and entity places
    the buckets and, for all horizons together, the ranks of the factor; the order by return gives the ranks of the returns.
    """
    from tidemark.session import materialize

    sizes = ", ".join(f"count({_return(h)})" for h in horizons)
    largest = labelled.groupBy("factor_name", "trade_date").agg(F.expr(f"greatest(0L, {sizes}) AS n")).agg(F.max("n")).first()[0] or 0
    if largest > SLICE_ROWS:
        rows = by_horizon(labelled, horizons, ["entity", "factor_name", "trade_date", "factor_value"])
        return materialize(rank_ic(rows, min_observations)), materialize(group_returns(rows, n_groups, min_group_size))
    section = "PARTITION BY factor_name, trade_date"
    # A factor without a direction has ranks and no groups.
    ordered = labelled.selectExpr("*", f"{direction_sign()} AS _sign").selectExpr("*", "factor_value * coalesce(_sign, 1) AS _value")
    counts, rows = [], []
    for h in horizons:
        up_to = f"count({_return(h)}) OVER ({section} ORDER BY _value"
        counts += [
            f"{up_to}, entity ROWS UNBOUNDED PRECEDING) AS _row_{h}",
            f"{up_to} RANGE UNBOUNDED PRECEDING) AS _upto_{h}",
            f"{up_to} RANGE BETWEEN CURRENT ROW AND CURRENT ROW) AS _ties_{h}",
            f"count({_return(h)}) OVER ({section}) AS _n_{h}",
        ]
        rank = f"_upto_{h} - (_ties_{h} - 1) / 2"
        rows += [
            f"{h}L", _return(h),
            # Where lower is better, the factor's own order is the reverse, but NaN is the highest value in both. All ranks of a
            # section are moved by the number of its NaN, which no correlation sees.
            f"CASE WHEN _sign = -1 THEN CASE WHEN isnan(_value) THEN {rank} + _ties_{h} ELSE _n_{h} + 1 - ({rank}) END ELSE {rank} END",
            f"CASE WHEN _sign IS NOT NULL AND _n_{h} >= {n_groups * min_group_size} THEN ((_row_{h} - 1) * {n_groups}) div _n_{h} END",
        ]
    peers = f"OVER (PARTITION BY {', '.join(CROSS_SECTION)} ORDER BY forward_return"
    found = materialize(
        ordered.selectExpr("*", *counts)
        .selectExpr("factor_name", "trade_date", f"stack({len(horizons)}, {', '.join(rows)}) AS (horizon, forward_return, _x, _bucket)")
        .filter("forward_return IS NOT NULL")
        .selectExpr("*", f"(rank() {peers}) + count(*) {peers} RANGE UNBOUNDED PRECEDING)) / 2 AS _y")
        .groupBy(*CROSS_SECTION)
        .agg(*_ic_columns(min_observations), *_group_columns("_bucket", n_groups))
    )
    return _oriented(found.select(*CROSS_SECTION, "valid_n", "rank_ic")), _spread(found.drop("valid_n", "rank_ic"))


def decay_curve(ic: DataFrame, groups: DataFrame) -> DataFrame:
    """IC and group returns per factor and horizon; keys of either side are kept."""
    left = ic.groupBy("factor_name", "horizon").agg(
        F.expr("count(rank_ic) AS valid_ic_dates"),
        F.expr("avg(rank_ic) AS mean_rank_ic"),
        F.expr(f"{_mean_over_std('rank_ic')} AS icir"),
        F.expr("avg(oriented_rank_ic) AS mean_oriented_rank_ic"),
        F.expr(f"{_mean_over_std('oriented_rank_ic')} AS oriented_icir"),
    )
    right = groups.groupBy("factor_name", "horizon").agg(
        F.expr("count(top_minus_bottom_return) AS valid_group_dates"),
        *[
            F.expr(f"avg({c}) AS mean_{c}")
            for c in ("top_return", "bottom_return", "top_minus_bottom_return", "long_short_return")
        ],
    )
    return left.join(right, ["factor_name", "horizon"], "full_outer").withColumns(
        {c: F.expr(f"coalesce({c}, 0)") for c in ("valid_ic_dates", "valid_group_dates")}
    )


def yearly_stability(ic: DataFrame, groups: DataFrame) -> DataFrame:
    keys = ["factor_name", "year", "horizon"]
    left = ic.selectExpr("*", "year(trade_date) AS year").groupBy(*keys).agg(
        F.expr("count(rank_ic) AS valid_ic_dates"),
        F.expr("count(oriented_rank_ic) AS valid_oriented_ic_dates"),
        F.expr("avg(rank_ic) AS mean_rank_ic"),
        F.expr("avg(oriented_rank_ic) AS mean_oriented_rank_ic"),
        F.expr(f"{_mean_over_std('oriented_rank_ic')} AS oriented_icir"),
        F.expr("avg(CAST(oriented_rank_ic > 0 AS INT)) AS positive_oriented_ic_ratio"),
    )
    right = groups.selectExpr("*", "year(trade_date) AS year").groupBy(*keys).agg(
        F.expr("count(DISTINCT trade_date) AS valid_group_dates"),
        F.expr("avg(top_minus_bottom_return) AS mean_top_minus_bottom_label_return"),
    )
    return left.join(right, keys, "left").withColumn(
        "valid_group_dates", F.expr("coalesce(valid_group_dates, 0)")
    )


def label_summary(labels: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Label count and latest usable signal date per horizon, empty horizons kept."""
    listed = ", ".join(f"{h}L" for h in horizons)
    wanted = labels.sparkSession.range(1).selectExpr(f"explode(array({listed})) AS horizon")
    found = labels.groupBy("horizon").agg(
        F.expr("count(forward_return) AS valid_label_count"),
        F.expr("max(CASE WHEN forward_return IS NOT NULL THEN trade_date END) AS latest_usable_signal_date"),
    )
    return wanted.join(found, "horizon", "left").withColumn(
        "valid_label_count", F.expr("coalesce(valid_label_count, 0)")
    )


def validate(
    factor_values: DataFrame,
    prices: DataFrame,
    calendar: DataFrame,
    universe: DataFrame,
    names: Sequence[str],
    horizons: Sequence[int],
    n_groups: int,
    min_observations: int,
    min_group_size: int = 1,
) -> dict[str, DataFrame]:
    """All validation frames over one labelled table, written once.

    Its ranks and groups are computed once and written too: a caller that writes each frame runs a job per frame.
    """
    from tidemark.session import materialize

    returns = forward_returns(prices, calendar, horizons)
    columns = [_return(h) for h in horizons]
    known = returns.filter(f"coalesce({', '.join(columns)}) IS NOT NULL")
    rows = factor_values.filter(F.col("factor_name").isin(list(names))).filter("factor_value IS NOT NULL")
    labelled = materialize(rows.join(known, ["entity", "trade_date"]).select("entity", "factor_name", "trade_date", "factor_value", *columns))
    ic, groups = cross_sections(labelled, horizons, n_groups, min_observations, min_group_size)
    dates = factor_values.select("trade_date").distinct()
    return {
        "label_summary": label_summary(by_horizon(returns, horizons, ["entity", "trade_date"]), horizons),
        "coverage": coverage(factor_values, universe, dates, names),
        "rank_ic": ic,
        "ic_summary": ic_summary(ic),
        "group_returns": groups,
        "decay_curve": decay_curve(ic, groups),
        "yearly_ic_summary": yearly_stability(ic, groups),
    }
