"""Factors for all entities and all dates in one pass.

Time-series factors share one window specification, hence one shuffle by
entity and one sort.  A panel holds at most one row per entity and open day, so
an entity's window is bounded by the length of the calendar.  Cross-sectional
factors go through the sliced ranks of :mod:`tidemark.functions.ranks`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import open_days
from tidemark.functions.ranks import first_per_key, largest_group, with_average_rank
from tidemark.operators.asof import DELISTED_FROM, VISIBLE_FROM, VISIBLE_UNTIL, active_on_dates, intervals_on_dates, keys_on_dates, latest_revisions, on_dates
from tidemark.params import FACTOR_ORDER, FACTOR_PARAMS
from tidemark.session import materialize
from tidemark.sources.history import History

PRICE_FACTORS = [
    "return_20d", "return_60d", "above_ma60", "volatility_20d", "max_drawdown_60d", "amount_cv_20d", "low_liquidity",
]
FLAG_FACTORS = ["is_st", "is_suspended", "is_delisted"]
VALUATION_FACTORS = ["pe_ttm_percentile", "pb_percentile", "industry_pe_ttm_percentile"]
FINANCIAL_FACTORS = ["revenue_yoy", "profit_yoy", "operating_cashflow_to_profit"]

# Which panel rows the windows of a factor count.
HISTORY_KINDS = {"rows": "true", "pe_ttm": "pe_ttm > 0", "pb": "pb > 0"}


def rows_before(names: Sequence[str], params: dict = FACTOR_PARAMS) -> dict[str, int]:
    """Per kind of row, how many of an entity's earlier rows the named factors of a day can see."""
    price = {
        "return_20d": params["return_short"],
        "return_60d": params["return_long"],
        "above_ma60": params["ma_window"] - 1,
        # The oldest return of the window needs the price before it.
        "volatility_20d": params["volatility_window"],
        "max_drawdown_60d": params["drawdown_window"] - 1,
        "amount_cv_20d": params["amount_window"] - 1,
        "low_liquidity": params["amount_window"] - 1,
    }
    valued = params["valuation_window"] - 1
    return {
        "rows": max((price[n] for n in names if n in price), default=0),
        "pe_ttm": valued if "pe_ttm_percentile" in names else 0,
        "pb": valued if "pb_percentile" in names else 0,
    }


ADJUSTED_CLOSE = "close * coalesce(adj_factor, 1.0D)"
# NULL for a missing or non-positive close.
STRICT_ADJUSTED_CLOSE = "CASE WHEN close > 0 THEN close * coalesce(adj_factor, 1.0D) END"

_SERIES = "PARTITION BY entity ORDER BY trade_date"


def _last(n: int) -> str:
    return f"OVER ({_SERIES} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def with_drawdown(series: DataFrame, value: str, out: str, n: int) -> DataFrame:
    """Add the worst fall from a peak within the last ``n`` rows of each entity; NULL unless all ``n`` values are positive.

    The fold of a window is associative: a stretch is known by its peak, its low and its worst fall, and of two stretches
    in a row the worst fall is that of either, or from the peak of the first to the low of the second.  Rows are cut into blocks of
    ``n``, so a window is the end of one block and the start of the next: folds from both ends of every block are running
    maxima and minima, and one merge per row is left.
    """
    block = "PARTITION BY entity, _block ORDER BY"
    down, up = f"OVER ({block} trade_date DESC ROWS UNBOUNDED PRECEDING)", f"OVER ({block} trade_date ROWS UNBOUNDED PRECEDING)"
    # Ordered by block and date, the rows lie as the windows before have left them.
    rows = "OVER (PARTITION BY entity ORDER BY _block, trade_date)"
    valid = f"count(CASE WHEN {value} > 0 THEN 1 END) OVER (PARTITION BY entity ORDER BY _block, trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    merged = (
        f"CASE WHEN _row % {n} = {n - 1} THEN _worst ELSE "
        f"greatest(_worst, lag(_end_worst, {n - 1}) {rows}, 1 - _low / lag(_end_peak, {n - 1}) {rows}) END"
    )
    return (
        series.selectExpr("*", f"row_number() OVER ({_SERIES}) - 1 AS _row")
        .selectExpr("*", f"_row div {n} AS _block")
        .selectExpr("*", f"max({value}) {down} AS _end_peak", f"min({value}) {down} AS _end_low")
        .selectExpr("*", f"max(1 - try_divide(_end_low, {value})) {down} AS _end_worst")
        .selectExpr("*", f"max({value}) {up} AS _peak", f"min({value}) {up} AS _low")
        .selectExpr("*", f"max(1 - try_divide({value}, _peak)) {up} AS _worst")
        .selectExpr(*series.columns, f"CASE WHEN {valid} = {n} THEN {merged} END AS {out}")
    )


def price_factors(prices: DataFrame, names: Sequence[str] = PRICE_FACTORS, params: dict = FACTOR_PARAMS) -> DataFrame:
    """Wide price factors; NULL where a factor is not defined on that date."""
    ma, vol = params["ma_window"], params["volatility_window"]
    dd, amt = params["drawdown_window"], params["amount_window"]
    mean_amount = f"avg(amount) {_last(amt)}"
    full_amount = f"count(amount) {_last(amt)} = {amt}"

    def past_return(n: int) -> str:
        return f"try_divide(adj, lag(adj, {n}) OVER ({_SERIES})) - 1"

    rules = {
        "return_20d": past_return(params["return_short"]),
        "return_60d": past_return(params["return_long"]),
        "above_ma60": f"CASE WHEN count(adj) {_last(ma)} = {ma} THEN CAST(adj > avg(adj) {_last(ma)} AS DOUBLE) END",
        "volatility_20d": f"CASE WHEN count(ret) {_last(vol)} = {vol} THEN stddev_pop(ret) {_last(vol)} END",
        "max_drawdown_60d": "_drawdown",
        "amount_cv_20d": f"CASE WHEN {full_amount} AND {mean_amount} > 0 "
        f"THEN stddev_pop(amount) {_last(amt)} / {mean_amount} END",
        "low_liquidity": f"CASE WHEN {full_amount} THEN CAST({mean_amount} < {params['min_avg_amount']}D AS DOUBLE) END",
    }
    series = prices.selectExpr("entity", "trade_date", "amount", f"{ADJUSTED_CLOSE} AS adj")
    if "max_drawdown_60d" in names:
        series = with_drawdown(series, "adj", "_drawdown", params["drawdown_window"])
    return series.selectExpr("*", f"{past_return(1)} AS ret").selectExpr(
        "entity", "trade_date", *[f"{rules[n]} AS {n}" for n in names]
    )


def _delistings(securities: DataFrame) -> DataFrame:
    return securities.filter("delist_date IS NOT NULL").selectExpr("entity", f"{DELISTED_FROM} AS _gone")


def calculation_universe(
    members: DataFrame, securities: DataFrame, dates: DataFrame, index_code: str | None, include_delisted: bool = False
) -> DataFrame:
    """Distinct ``entity, trade_date`` to compute: members on each date minus the delisted."""
    base = members if index_code is None else members.filter(F.col("index_code") == index_code)
    active = active_on_dates(base, ["entity"], dates)
    if include_delisted:
        return active
    return active.join(_delistings(securities), "entity", "left").filter(
        "coalesce(trade_date < _gone, true)"
    ).drop("_gone")


def in_universe(
    rows: DataFrame, members: DataFrame, securities: DataFrame, dates: DataFrame, index_code: str | None, include_delisted: bool = False
) -> DataFrame:
    """The rows whose entity and date are in :func:`calculation_universe`, tested against its intervals: the dates of a member are not listed.

    Only intervals and dates meet the rows, which keep their partitioning by entity.
    """
    base = members if index_code is None else members.filter(F.col("index_code") == index_code)
    held = base.selectExpr("entity AS _member", f"{VISIBLE_FROM} AS _from", f"{VISIBLE_UNTIL} AS _until")
    inside = "entity = _member AND trade_date >= _from AND coalesce(trade_date < _until, true)"
    if not include_delisted:
        # Of several delistings the last one ends it, as any row that is not yet delisted lets a date pass.
        last = _delistings(securities).groupBy(F.expr("entity AS _listed")).agg(F.expr("max(_gone) AS _gone"))
        held = held.join(last, F.expr("_member = _listed"), "left").drop("_listed")
        inside += " AND coalesce(trade_date < _gone, true)"
    return rows.join(held, F.expr(inside), "left_semi").join(dates.select("trade_date"), "trade_date", "left_semi").select(*rows.columns)


def listed_universe(securities: DataFrame, dates: DataFrame) -> DataFrame:
    """All listed, not yet delisted securities on each date."""
    return keys_on_dates(securities, ["entity"], "list_date", DELISTED_FROM, dates)


def flag_factors(
    universe: DataFrame, prices: DataFrame, securities: DataFrame, st_status: DataFrame, dates: DataFrame
) -> DataFrame:
    """0/1 flags for every member; a missing price row counts as suspended."""
    st = active_on_dates(st_status, ["entity"], dates).selectExpr("*", "1.0D AS _st")
    px = prices.selectExpr("entity", "trade_date", "CAST(coalesce(is_suspended, false) AS DOUBLE) AS _susp")
    return (
        universe.join(st, ["entity", "trade_date"], "left")
        .join(px, ["entity", "trade_date"], "left")
        .join(_delistings(securities), "entity", "left")
        .selectExpr(
            "entity",
            "trade_date",
            "coalesce(_st, 0.0D) AS is_st",
            "coalesce(_susp, 1.0D) AS is_suspended",
            "coalesce(CAST(_gone <= trade_date AS DOUBLE), 0.0D) AS is_delisted",
        )
    )


def _block_of(window: int) -> int:
    """Divisor of the window next to its root, so that few values are compared one by one and few sorted per row."""
    return min((d for d in range(1, window + 1) if window % d == 0), key=lambda d: abs(d - window**0.5))


def history_percentile(
    valuations: DataFrame, column: str, name: str, params: dict = FACTOR_PARAMS, dates: DataFrame | None = None
) -> DataFrame:
    """Average-rank percentile of the current value among its own last valid values; with ``dates``, of the values of those dates only.

    An entity's values are cut into blocks of a size that divides the window.  A window then is the end of one block, the same number of whole
    blocks for every row, and the start of its own block.  The whole blocks are sorted once per block and searched by bisection;
    only the two open ends, together one block long, are compared value by value.  Blocks without a requested date are seen by later ones and
    not sorted or searched themselves.
    """
    rows = valuations.filter(f"{column} > 0").selectExpr("entity", "trade_date", f"{column} AS v")
    if dates is None:
        rows = rows.selectExpr("*", "true AS _asked")
    else:
        asked = dates.selectExpr("trade_date AS _day").distinct()
        rows = rows.join(asked, F.expr("trade_date = _day"), "left").selectExpr("entity", "trade_date", "v", "_day IS NOT NULL AS _asked")
    window = params["valuation_window"]
    size = _block_of(window)
    whole = window // size - 1
    steps = ", ".join(str(1 << i) for i in reversed(range(max(1, (whole * size).bit_length()))))
    # Number of values of the sorted whole blocks below v (or, for equal values only, below or equal).
    search = (
        "aggregate(array({steps}), 0, (low, step) -> CASE WHEN low + step <= reach AND get(whole, low + step - 1) {op} x.v"
        " THEN low + step ELSE low END)"
    )
    less, up_to = (search.format(steps=steps, op=op) for op in ("<", "<="))
    wanted = "filter(transform(own, (x, i) -> named_struct('trade_date', x.trade_date, 'v', x.v, 'i', i, 'asked', x._asked)), x -> x.asked)"
    placed = f"transform({wanted}, x -> named_struct('trade_date', x.trade_date, 'v', x.v, 'i', x.i, 'less', {less}))"
    # Twice the rank, in whole numbers.
    twice = "(acc, y) -> acc + CASE WHEN y < x.v THEN 2 WHEN y = x.v THEN 1 ELSE 0 END"
    compared = f"aggregate(slice(own.v, 1, x.i + 1), aggregate(slice(oldest, x.i + 2, {size}), 0, {twice}), {twice})"
    ranked = (
        f"transform(placed, x -> named_struct('trade_date', x.trade_date, 'below',"
        f" {compared} + x.less + CASE WHEN get(whole, x.less) = x.v THEN {up_to} ELSE x.less END,"
        " 'n', x.i + 1 + reach + greatest(size(oldest) - x.i - 1, 0)))"
    )
    by_block = "OVER (PARTITION BY entity ORDER BY _block"
    return (
        rows.selectExpr("*", f"(row_number() OVER ({_SERIES}) - 1) div {size} AS _block")
        .groupBy("entity", "_block")
        .agg(F.expr("sort_array(collect_list(struct(trade_date, v, _asked))) AS own"))
        .selectExpr(
            "entity", "own",
            f"coalesce(lag(own.v, {whole + 1}) {by_block}), array()) AS oldest",
            f"collect_list(own.v) {by_block} ROWS BETWEEN {whole} PRECEDING AND 1 PRECEDING) AS blocks"
            if whole else "array(slice(own.v, 1, 0)) AS blocks",
        )
        .filter("exists(own, x -> x._asked)")
        .selectExpr("entity", "own", "oldest", "sort_array(flatten(blocks)) AS whole")
        .selectExpr("*", "size(whole) AS reach")
        .selectExpr("*", f"{placed} AS placed")
        .selectExpr("entity", f"inline({ranked})")
        .filter(f"n >= {max(2, params['valuation_min_observations'])}")
        .selectExpr("entity", "trade_date", f"(below / 2.0D - 0.5D) / (n - 1) AS {name}")
    )


def industry_on_dates(industries: DataFrame, dates: DataFrame) -> DataFrame:
    """One industry per entity and date: the interval entered last."""
    known = intervals_on_dates(industries.filter("industry_l1 IS NOT NULL"), dates)
    return first_per_key(
        known.select("entity", "trade_date", "in_date", "industry_l1", "industry_l2"),
        ["entity", "trade_date"],
        ["in_date DESC", "industry_l1", "industry_l2"],
    )


def industry_percentile(
    valuations: DataFrame, industries: DataFrame, dates: DataFrame, params: dict = FACTOR_PARAMS
) -> DataFrame:
    """Average-rank percentile of positive pe inside an industry on each date."""
    # Written once: the sliced rank reads its input in several branches.
    base = materialize(
        valuations.filter("pe_ttm > 0")
        .select("entity", "trade_date", "pe_ttm")
        .join(industry_on_dates(industries, dates), ["entity", "trade_date"])
        .select("entity", "trade_date", "industry_l1", "pe_ttm")
    )
    ranked = with_average_rank(
        base, ["trade_date", "industry_l1"], "pe_ttm", "_rank", "_size", largest=largest_group(base, ["trade_date", "industry_l1"])
    )
    return ranked.filter(f"_size >= {max(2, params['industry_min_observations'])}").selectExpr(
        "entity", "trade_date", "(_rank - 1) / (_size - 1) AS industry_pe_ttm_percentile"
    )


def year_over_year(current: str, previous: str) -> str:
    return f"CASE WHEN {previous} > 0 THEN {current} / {previous} - 1 END"


def cash_to_profit(cash: str, profit: str) -> str:
    return f"CASE WHEN {profit} > 0 THEN {cash} / {profit} END"


def financial_factors(fundamentals: DataFrame, dates: DataFrame) -> DataFrame:
    """Growth and cash quality of the latest visible report on every date.

    The state of an entity changes only on days when a report becomes visible.
    It is computed once per such day and then spread over the requested dates.
    """
    values = ["revenue", "net_profit", "operating_cashflow"]
    revisions = latest_revisions(fundamentals, ["entity", "report_period"]).select(
        "entity", "report_period", "visible_on", "replaced_on", *values
    )
    by_day = "PARTITION BY entity ORDER BY visible_on"
    changes = (
        revisions.groupBy("entity", "visible_on")
        .agg(F.expr("max(report_period) AS newest"))
        .selectExpr(
            "entity",
            "visible_on AS at",
            f"max(newest) OVER ({by_day}) AS period",
            f"lead(visible_on) OVER ({by_day}) AS until",
        )
    )

    def version(prefix: str, period: str) -> DataFrame:
        return revisions.selectExpr(
            "entity", f"report_period AS {period}", f"visible_on AS {prefix}from", f"replaced_on AS {prefix}to",
            *[f"{v} AS {prefix}{v}" for v in values],
        )

    valid = "{0}from <= at AND coalesce(at < {0}to, true)"
    current = (
        changes.join(version("c_", "period"), ["entity", "period"])
        .filter(valid.format("c_"))
        .selectExpr("*", "add_months(period, -12) AS prior")
    )
    before = (
        current.select("entity", "at", "prior")
        .join(version("p_", "prior"), ["entity", "prior"])
        .filter(valid.format("p_"))
        .drop("prior")
    )
    state = current.join(before, ["entity", "at"], "left").selectExpr(
        "entity",
        "at",
        "until",
        f"{year_over_year('c_revenue', 'p_revenue')} AS revenue_yoy",
        f"{year_over_year('c_net_profit', 'p_net_profit')} AS profit_yoy",
        f"{cash_to_profit('c_operating_cashflow', 'c_net_profit')} AS operating_cashflow_to_profit",
    )
    return on_dates(state, "at", "until", dates).select("entity", "trade_date", *FINANCIAL_FACTORS)


def to_long(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """Tidy factor rows; NULL and non-finite values are not written."""
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    return (
        wide.selectExpr("entity", "trade_date", f"stack({len(names)}, {pairs}) AS (factor_name, factor_value)")
        .filter("factor_value IS NOT NULL AND abs(factor_value) < double('Infinity')")
        .selectExpr("*", "trade_date AS as_of_date")
    )


def all_factors(
    tables,
    dates: DataFrame,
    names: Sequence[str] = FACTOR_ORDER,
    index_code: str | None = None,
    include_delisted: bool = True,
    params: dict = FACTOR_PARAMS,
    panels: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Long factor rows of the universe on the requested dates.

    Windows see the whole history; the date restriction applies to their output.  With ``panels``, see :func:`range_factors`,
    they see the rows given per kind instead, and factors of a single day those under ``day``.
    """
    from tidemark.plans.views import INDEX_CODE

    universe = (tables.members, tables.securities, dates, index_code or INDEX_CODE, include_delisted)

    def pick(family: Sequence[str]) -> list[str]:
        return [n for n in family if n in names]

    def panel(kind: str, whole: DataFrame) -> DataFrame:
        return whole if panels is None else panels[kind].select(*whole.columns)

    parts = []
    if pick(PRICE_FACTORS):
        parts.append(to_long(price_factors(panel("rows", tables.prices), pick(PRICE_FACTORS), params), pick(PRICE_FACTORS)))
    if pick(FLAG_FACTORS):
        members = calculation_universe(*universe)
        flags = flag_factors(members, panel("day", tables.prices), tables.securities, tables.st_status, dates)
        parts.append(to_long(flags, pick(FLAG_FACTORS)))
    for name, column in (("pe_ttm_percentile", "pe_ttm"), ("pb_percentile", "pb")):
        if name in names:
            parts.append(to_long(history_percentile(panel(column, tables.valuations), column, name, params, dates), [name]))
    if pick(FINANCIAL_FACTORS):
        parts.append(to_long(financial_factors(tables.fundamentals, dates), pick(FINANCIAL_FACTORS)))
    if "industry_pe_ttm_percentile" in names:
        # The cross-section is the universe, so restrict before ranking.
        members = in_universe(panel("day", tables.valuations), *universe)
        ranked = industry_percentile(members, tables.industries, dates, params)
        parts.append(to_long(ranked, ["industry_pe_ttm_percentile"]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return in_universe(out, *universe)


def range_factors(
    tables,
    history: History,
    start: date | str,
    end: date | str,
    names: Sequence[str] = FACTOR_ORDER,
    index_code: str | None = None,
    include_delisted: bool = True,
    params: dict = FACTOR_PARAMS,
) -> DataFrame:
    """The rows of :func:`all_factors` on the open days from ``start`` to ``end``, without reading the whole history.

    Each family of windows gets the rows that it can see and no more, see :meth:`History.reach`.
    """
    reach = {kind: history.reach(kind, tables.calendar, start, end, n) for kind, n in rows_before(names, params).items() if n}
    reach["day"] = history.reach("rows", tables.calendar, start, end, 0)
    return all_factors(tables, open_days(tables.calendar, start, end), names, index_code, include_delisted, params, reach)


def canonical_order(long: DataFrame) -> DataFrame:
    """Date, factor in its declared order, entity."""
    position = F.array_position(F.array(*[F.lit(n) for n in FACTOR_ORDER]), F.col("factor_name"))
    return long.orderBy("trade_date", position, "entity")
