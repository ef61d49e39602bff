"""Set-based portfolio analytics: schedules, orders, baskets, NAV and metrics.

Weights are held from one executed order to the next; there is no cash book.
Windows without an entity key run over one row per trading day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import day_key, dense_days, month_ends, next_open, open_days
from tidemark.operators.asof import DELISTED_FROM, on_dates
from tidemark.operators.factors import STRICT_ADJUSTED_CLOSE
from tidemark.params import TRADING


def schedule(calendar: DataFrame, start: str, end: str, factor_dates: DataFrame) -> DataFrame:
    """Month-end signals with execution date and the reason a signal is skipped."""
    signals = next_open(month_ends(calendar, start, end).select("signal_date"), "signal_date", calendar, "execution_date")
    present = factor_dates.selectExpr("trade_date AS signal_date", "true AS _has").distinct()
    return signals.join(present, "signal_date", "left").selectExpr(
        "signal_date",
        "execution_date",
        f"CASE WHEN execution_date IS NULL THEN 'execution_date does not exist' "
        f"WHEN execution_date > DATE'{end}' THEN 'execution_date after end_date' "
        "WHEN _has IS NULL THEN 'no factor rows' ELSE '' END AS skip_reason",
    )


def bounded_execution(signals: DataFrame, calendar: DataFrame, end: str) -> DataFrame:
    nxt = next_open(signals, "signal_date", calendar, "next_open")
    return nxt.selectExpr(
        "signal_date", "next_open", f"CASE WHEN next_open <= DATE'{end}' THEN next_open END AS execution_date"
    )


def target_notional(targets: DataFrame, nav: float) -> DataFrame:
    return targets.selectExpr("*", f"greatest(target_weight * {nav}D, 0.0D) AS target_notional")


def executions(targets: DataFrame, calendar: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """Every signal with its execution day, the next one and its number.

    ``signals`` is the executable schedule; a signal without any target is a rebalance that sells everything.
    Without a schedule only signals with targets count.
    """
    # One row per signal date: bounded by the calendar.
    days = (targets if signals is None else signals).select("signal_date").distinct()
    return next_open(days, "signal_date", calendar, "execution_date").filter("execution_date IS NOT NULL").selectExpr(
        "signal_date",
        "execution_date",
        "lead(execution_date) OVER (ORDER BY signal_date) AS next_execution",
        "row_number() OVER (ORDER BY signal_date) AS k",
    )


def holding_periods(targets: DataFrame, calendar: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """Targets with execution day and the execution day of the following signal."""
    return targets.join(executions(targets, calendar, signals), "signal_date")


def orders(targets: DataFrame, calendar: DataFrame, nav: float, signals: DataFrame | None = None) -> DataFrame:
    """Weight changes at each execution day against the previous target set.

    Each target counts for its own signal and, as the old weight, for the next
    one, so the comparison is one aggregation instead of a self-join.
    """
    held = holding_periods(targets, calendar, signals)
    signals = executions(targets, calendar, signals).select("k", "signal_date", "execution_date")
    moves = held.selectExpr(
        "entity",
        "explode(array(named_struct('k', k, 'new', target_weight, 'old', 0.0D), "
        "named_struct('k', k + 1, 'new', 0.0D, 'old', target_weight))) AS m",
    ).selectExpr("entity", "m.k AS k", "m.new AS new_w", "m.old AS old_w")
    return (
        moves.groupBy("entity", "k")
        .agg(F.expr("sum(new_w) AS new_weight"), F.expr("sum(old_w) AS old_weight"))
        .filter("abs(new_weight - old_weight) > 1e-12D")
        .join(signals, "k")
        .selectExpr(
            "signal_date", "execution_date", "entity", "old_weight", "new_weight",
            "CASE WHEN new_weight > old_weight THEN 'buy' ELSE 'sell' END AS side",
            f"abs(new_weight - old_weight) * {nav}D AS intended_notional",
            f"old_weight * {nav}D AS held_notional",
        )
    )


def reject_reason(rules: dict = TRADING) -> str:
    """SQL: first obstacle of an order, NULL when it can trade."""
    tol = rules["price_tolerance"]
    return (
        "CASE WHEN side = 'buy' AND coalesce(delisted, false) THEN 'delisted' "
        "WHEN NOT coalesce(has_price, false) THEN 'missing_daily_price' "
        "WHEN coalesce(open, 0) <= 0 THEN 'missing_or_invalid_open' "
        "WHEN coalesce(is_suspended, false) THEN 'suspended' "
        f"WHEN side = 'buy' AND open >= limit_up - {tol}D THEN 'limit_up' "
        f"WHEN side = 'sell' AND open <= limit_down + {tol}D THEN 'limit_down' END"
    )


def execution_state(rows: DataFrame, prices: DataFrame, securities: DataFrame) -> DataFrame:
    """Rows by entity and execution day with all that ``reject_reason`` looks at."""
    px = prices.selectExpr(
        "entity", "trade_date AS execution_date", "open", "is_suspended", "limit_up", "limit_down", "true AS has_price"
    )
    gone = securities.filter("delist_date IS NOT NULL").selectExpr("entity", f"{DELISTED_FROM} AS _gone")
    return (
        rows.join(px, ["entity", "execution_date"], "left")
        .join(gone, "entity", "left")
        .selectExpr("*", "_gone <= execution_date AS delisted")
    )


def classify_orders(order_rows: DataFrame, prices: DataFrame, securities: DataFrame) -> DataFrame:
    state = execution_state(order_rows, prices, securities)
    return state.selectExpr(*order_rows.columns, "open", f"{reject_reason()} AS reject_reason")


def held_orders(
    targets: DataFrame,
    calendar: DataFrame,
    nav: float,
    prices: DataFrame,
    securities: DataFrame,
    signals: DataFrame | None = None,
    rules: dict = TRADING,
) -> DataFrame:
    """Orders against the weights that earlier orders really left, with ``weight_after``.

    A rejected order leaves the weight, so the entity is ordered again at the next execution day; an executed one reaches its
    target, and a delisted entity holds nothing.  Each entity folds its own execution days, which are as many
    as the schedule has, so entities are independent and no list grows with the rows.
    """
    days = executions(targets, calendar, signals).selectExpr("*", "count(*) OVER () AS n")
    wanted = targets.join(days.select("signal_date", "k", "n"), "signal_date")
    wanted = wanted.groupBy("entity", "k", "n").agg(F.expr("sum(target_weight) AS weight"))
    grid = (
        wanted.groupBy("entity", "n")
        .agg(F.expr("min(k) AS first"), F.expr("map_from_entries(collect_list(struct(k, weight))) AS weights"))
        .selectExpr("entity", "weights", "explode(sequence(first, CAST(n AS INT))) AS k")
        .selectExpr("entity", "k", "coalesce(weights[k], 0.0D) AS target")
    )
    state = execution_state(grid.join(days.select("k", "signal_date", "execution_date"), "k"), prices, securities)
    for side in ("buy", "sell"):
        state = state.selectExpr("*", f"'{side}' AS side").selectExpr("*", f"{reject_reason(rules)} AS no_{side}").drop("side")
    folded = state.groupBy("entity").agg(
        F.expr(
            "sort_array(collect_list(named_struct('k', k, 'target', target, 'open', open, 'no_buy', no_buy, 'no_sell', no_sell, "
            "'gone', coalesce(delisted, false)))) AS days"
        )
    )
    lot, price = rules["lot_size"], f"(d.open * {1 + rules['slippage_bps'] / 10_000.0}D)"
    old = "(CASE WHEN d.gone THEN 0.0D ELSE a.held END)"
    held, wish = f"({old} * {nav}D / d.open)", f"(({old} - d.target) * {nav}D / d.open)"
    trades = (
        f"coalesce(CASE WHEN d.target > {old} THEN d.no_buy IS NULL AND {round_lot(f'((d.target - {old}) * {nav}D / {price})', lot)} > 0 "
        f"ELSE d.no_sell IS NULL AND {round_sell(f'least({held}, {wish})', held, lot)} > 1e-12D END, false)"
    )
    changed = f"abs(d.target - {old}) > 1e-12D"
    after = f"CASE WHEN {changed} AND {trades} THEN d.target ELSE {old} END"
    step = f"named_struct('k', d.k, 'old', {old}, 'new', d.target, 'after', {after})"
    none = "CAST(array() AS array<struct<k: int, old: double, new: double, after: double>>)"
    moves = folded.selectExpr(
        "entity",
        f"explode(aggregate(days, named_struct('held', 0.0D, 'moves', {none}), (a, d) -> named_struct('held', {after}, "
        f"'moves', CASE WHEN {changed} THEN array_append(a.moves, {step}) ELSE a.moves END), a -> a.moves)) AS m",
    ).selectExpr("entity", "m.k AS k", "m.old AS old_weight", "m.new AS new_weight", "m.after AS weight_after")
    return moves.join(days.select("k", "signal_date", "execution_date"), "k").selectExpr(
        "signal_date", "execution_date", "entity", "old_weight", "new_weight",
        "CASE WHEN new_weight > old_weight THEN 'buy' ELSE 'sell' END AS side",
        f"abs(new_weight - old_weight) * {nav}D AS intended_notional",
        f"old_weight * {nav}D AS held_notional",
        "weight_after",
    )


def held_periods(order_rows: DataFrame) -> DataFrame:
    """Weights from one executed order of ``held_orders`` to the entity's next executed one."""
    done = order_rows.filter("weight_after = new_weight").selectExpr(
        "entity", "signal_date", "execution_date", "new_weight AS target_weight",
        "lead(execution_date) OVER (PARTITION BY entity ORDER BY execution_date) AS next_execution",
    )
    return done.filter("target_weight > 0")


def trade_costs(side: str, notional: str, rules: dict = TRADING) -> str:
    """SQL struct of commission and stamp tax of one order."""
    n = f"abs({notional})"
    return (
        f"named_struct('commission', CASE WHEN {n} > 0 THEN greatest({n} * {rules['commission_bps']}D / 10000, "
        f"{rules['min_commission']}D) ELSE 0.0D END, "
        f"'stamp_tax', CASE WHEN {side} = 'sell' THEN {n} * {rules['stamp_tax_bps']}D / 10000 ELSE 0.0D END)"
    )


def round_lot(shares: str, lot: int) -> str:
    return f"CASE WHEN {shares} > 0 THEN floor({shares} / {lot}) * {lot} ELSE 0 END"


def round_sell(requested: str, held: str, lot: int) -> str:
    """SQL: a full exit sells all; else whole lots, plus the odd residual when it fits."""
    rounded, residual = round_lot(requested, lot), f"({held} - ({round_lot(held, lot)}))"
    return (
        f"CASE WHEN {requested} >= {held} - 1e-9D THEN greatest({held}, 0.0D) "
        f"WHEN {residual} > 1e-9D AND ({rounded}) + {residual} <= {requested} + 1e-9D THEN least(({rounded}) + {residual}, {held}) "
        f"WHEN ({rounded}) <= 1e-12D AND {residual} <= {requested} + 1e-9D THEN least({residual}, {held}) "
        f"ELSE least(CAST({rounded} AS DOUBLE), {held}) END"
    )


def execute_orders(classified: DataFrame, rules: dict = TRADING) -> DataFrame:
    """Ledger: status, executed price and shares, notional and the cost split."""
    lot, slip = rules["lot_size"], rules["slippage_bps"] / 10_000.0
    sized = (
        classified.selectExpr(
            "*",
            f"CASE WHEN side = 'buy' THEN open * (1 + {slip}D) ELSE open * (1 - {slip}D) END AS _price",
            "held_notional / nullif(open, 0) AS _held",
        )
        .selectExpr(
            "*",
            "CASE WHEN side = 'buy' THEN intended_notional / _price ELSE least(_held, intended_notional / open) END AS _req",
        )
        .selectExpr(
            "*",
            f"CASE WHEN reject_reason IS NOT NULL THEN 0.0D WHEN side = 'buy' THEN CAST({round_lot('_req', lot)} AS DOUBLE) "
            f"ELSE {round_sell('_req', '_held', lot)} END AS _shares",
        )
        .selectExpr("*", "coalesce(_shares, 0.0D) > 1e-12D AS _ok", "coalesce(_shares * _price, 0.0D) AS _notional")
        .selectExpr("*", f"{trade_costs('side', '_notional', rules)} AS _costs")
    )
    return sized.selectExpr(
        "signal_date", "execution_date", "entity", "side",
        "CASE WHEN _ok THEN 'executed' ELSE 'rejected' END AS order_status",
        "CASE WHEN NOT _ok THEN coalesce(reject_reason, 'below_board_lot') END AS reject_reason",
        "intended_notional",
        "CASE WHEN _ok THEN _notional ELSE 0.0D END AS executed_notional",
        "CASE WHEN _ok THEN _price ELSE 0.0D END AS executed_price",
        "CASE WHEN _ok THEN CASE WHEN side = 'buy' THEN _shares ELSE -_shares END ELSE 0.0D END AS shares_delta",
        "CASE WHEN _ok THEN _costs.commission ELSE 0.0D END AS commission",
        "CASE WHEN _ok THEN _costs.stamp_tax ELSE 0.0D END AS stamp_tax",
        "CASE WHEN _ok THEN abs(_notional - _shares * open) ELSE 0.0D END AS slippage_cost",
    ).selectExpr("*", "commission + stamp_tax + slippage_cost AS total_cost")


def forced_exits(
    targets: DataFrame, securities: DataFrame, calendar: DataFrame, signals: DataFrame | None = None
) -> DataFrame:
    """First open day on which a target is known to be delisted."""
    return exits_of(holding_periods(targets, calendar, signals), securities, calendar)


def exits_of(periods: DataFrame, securities: DataFrame, calendar: DataFrame) -> DataFrame:
    """First open day of a holding period on which its entity is known to be delisted."""
    gone = securities.filter("delist_date IS NOT NULL").selectExpr("entity", f"{DELISTED_FROM} AS _gone")
    due = periods.join(gone, "entity").selectExpr(
        "entity", "signal_date", "execution_date", "next_execution", "target_weight",
        "date_sub(greatest(_gone, execution_date), 1) AS _before",
    )
    found = next_open(due, "_before", calendar, "exit_date")
    return found.filter("exit_date IS NOT NULL AND coalesce(exit_date < next_execution, true)").selectExpr(
        "entity", "signal_date", "exit_date", "target_weight", "'forced_delist_exit' AS order_status"
    )


def holdings(targets: DataFrame, calendar: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """Held weights on every open day from execution up to the next execution."""
    held = holding_periods(targets, calendar, signals).select(
        "entity", "signal_date", "execution_date", "next_execution", "target_weight"
    )
    return on_dates(held, "execution_date", "next_execution", open_days(calendar))


def mark_to_market(held: DataFrame, prices: DataFrame, nav: float) -> DataFrame:
    """Shares bought for the target at the execution day's open, and their value at the close or last visible close.

    Without a valid open on the execution day nothing is held.
    """
    bought = prices.filter("open > 0").selectExpr("entity", "trade_date AS execution_date", "open AS _paid")
    held = held.join(bought, ["entity", "execution_date"], "left").withColumn(
        "shares", F.expr(f"coalesce(target_weight * {nav}D / _paid, 0.0D)")
    )
    px = prices.filter("close > 0").selectExpr("entity", "trade_date", "close AS _close", "open AS _open")
    last = "last(_close, true) OVER (PARTITION BY entity ORDER BY trade_date ROWS UNBOUNDED PRECEDING)"
    return (
        held.join(px, ["entity", "trade_date"], "left")
        .selectExpr("*", f"coalesce({last}, 0.0D) AS close")
        .selectExpr(
            "signal_date", "trade_date", "entity", "shares", "close", "shares * close AS market_value",
            "CASE WHEN _close IS NULL THEN 'last_visible_close' ELSE 'daily_close' END AS price_source",
        )
    )


def rebalance_summary(ledger: DataFrame, nav: float) -> DataFrame:
    executed = "order_status = 'executed'"
    out = ledger.groupBy("signal_date", "execution_date").agg(
        F.expr(f"coalesce(sum(executed_notional) FILTER (WHERE {executed} AND side = 'buy'), 0.0D) AS buy_notional"),
        F.expr(f"coalesce(sum(executed_notional) FILTER (WHERE {executed} AND side = 'sell'), 0.0D) AS sell_notional"),
        *[F.expr(f"sum({c}) AS {c}") for c in ("commission", "stamp_tax", "slippage_cost", "total_cost")],
        F.expr(f"count_if({executed}) AS executed_order_count"),
        F.expr("count_if(order_status = 'rejected') AS rejected_order_count"),
    )
    return out.selectExpr(
        "*", f"(buy_notional + sell_notional) / {nav}D AS gross_turnover",
        f"(buy_notional + sell_notional) / {nav}D / 2 AS one_way_turnover",
    )


# ---- benchmark baskets ----------------------------------------------------


def lock_dates(calendar: DataFrame, signals: DataFrame, start: str) -> DataFrame:
    """For every open day the signal whose basket applies."""
    marks = signals.selectExpr("signal_date AS trade_date", "true AS is_open")
    # Seen from the next day: the last signal up to today, or the first one still ahead.
    near = dense_days(marks, ["prev_open", "next_open"])
    near = near.selectExpr("day", "prev_open", "CASE WHEN prev_open IS NULL THEN next_open END AS ahead")
    days = open_days(calendar).filter(f"trade_date >= DATE'{start}'")
    return days.withColumn("_key", day_key("date_add(trade_date, 1)", marks)).join(near, F.expr("_key = day"), "left").selectExpr(
        "trade_date", f"coalesce(prev_open, least(ahead, DATE'{start}')) AS lock_date"
    )


def basket_weights(members: DataFrame, valuations: DataFrame) -> DataFrame:
    """Cap and equal weights per lock date; caps by first non-null field, else equal."""
    caps = valuations.selectExpr("entity", "trade_date AS lock_date", "coalesce(float_mv, total_mv) AS cap")
    rows = (
        members.selectExpr("entity", "trade_date AS lock_date")
        .distinct()
        .join(caps, ["entity", "lock_date"], "left")
        .selectExpr("entity", "lock_date", "CASE WHEN cap > 0 THEN cap END AS cap")
    )
    sums = rows.groupBy("lock_date").agg(F.expr("sum(cap) AS _sum"), F.expr("count(*) AS member_count"))
    return rows.join(sums, "lock_date").selectExpr(
        "lock_date", "entity", "member_count",
        "CASE WHEN _sum > 0 THEN coalesce(cap, 0.0D) / _sum ELSE 1.0D / member_count END AS cap_weight",
        "1.0D / member_count AS equal_weight",
    )


def daily_returns(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """Return against the previous open *calendar* day; NULL when suspended or missing.

    The previous position is read with a one-point RANGE frame, so a gap in the
    entity's rows gives NULL and not the older price.
    """
    from tidemark.functions.calendar import ordinals

    base = prices.selectExpr(
        "entity", "trade_date", f"{STRICT_ADJUSTED_CLOSE} AS adj", "coalesce(is_suspended, false) AS suspended"
    ).join(ordinals(calendar), "trade_date")
    prev = "max(adj) OVER (PARTITION BY entity ORDER BY ord RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)"
    return base.selectExpr("entity", "trade_date", "adj", "suspended", f"{prev} AS prev").selectExpr(
        "entity", "trade_date", "CASE WHEN NOT suspended THEN adj / prev - 1 END AS ret"
    )


def basket_returns(locks: DataFrame, weights: DataFrame, returns: DataFrame, weight: str) -> DataFrame:
    """Basket return and coverage per day; the first day is 0 with coverage 1."""
    daily = (
        locks.join(weights.selectExpr("lock_date", "entity", f"{weight} AS w"), "lock_date")
        .join(returns, ["entity", "trade_date"], "left")
        .groupBy("trade_date")
        .agg(
            F.expr("sum(w * coalesce(ret, 0.0D)) AS r"),
            F.expr("avg(CAST(ret IS NOT NULL AS INT)) AS c"),
            F.expr("count(*) AS member_count"),
        )
    )
    # One row per day: the unpartitioned minimum is bounded by the calendar.
    return (
        locks.selectExpr("trade_date", "min(trade_date) OVER () AS _start")
        .join(daily, "trade_date", "left")
        .selectExpr(
            "trade_date",
            "CASE WHEN trade_date = _start THEN 0.0D ELSE coalesce(r, 0.0D) END AS portfolio_return",
            "CASE WHEN member_count IS NULL THEN 0.0D WHEN trade_date = _start THEN 1.0D ELSE c END AS coverage",
            "coalesce(member_count, 0) AS member_count",
        )
    )


def with_nav(daily: DataFrame, column: str = "portfolio_return", initial: float = 1.0, out: str = "nav") -> DataFrame:
    """Compounded NAV: the exact running product of ``1 + return``; a null return leaves the NAV as it is.

    Size, sign and total losses run in windows of their own: a return of -1 ends at zero for good, one below -1 turns
    the sign.  One row per day, so the windows are bounded by the calendar.
    """
    so_far = "OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING)"
    growth = (
        f"CASE WHEN count_if(1 + {column} = 0) {so_far} > 0 THEN 0.0D "
        f"ELSE (1 - 2 * (count_if(1 + {column} < 0) {so_far} % 2)) "
        f"* exp(coalesce(sum(ln(nullif(abs(1 + {column}), 0.0D))) {so_far}, 0.0D)) END"
    )
    return daily.selectExpr("*", f"{initial}D * {growth} AS {out}")


def with_drawdown(curve: DataFrame, initial: float) -> DataFrame:
    peak = f"greatest({initial}D, max(nav) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING))"
    return curve.selectExpr("*", f"nav / {peak} - 1 AS drawdown")


def target_portfolio(
    order_rows: DataFrame,
    exits: DataFrame,
    calendar: DataFrame,
    returns: DataFrame,
    start: str,
    rules: dict = TRADING,
) -> DataFrame:
    """Daily gross and net return of the weights that ``held_orders`` and forced ``exits`` leave, with a turnover cost drag.

    A day's return uses the weights held before it; the drag falls on the
    execution day and counts executed orders only.
    """
    from tidemark.functions.calendar import ordinals

    periods = held_periods(order_rows).join(exits.select("entity", "signal_date", "exit_date"), ["entity", "signal_date"], "left")
    periods = periods.selectExpr("entity", "execution_date", "coalesce(exit_date, next_execution) AS until", "target_weight")
    held = on_dates(periods, "execution_date", "until", open_days(calendar)).select("entity", "trade_date", "target_weight")
    place = ordinals(calendar)
    later = place.selectExpr("trade_date AS next_date", "ord - 1 AS ord")
    carried = (
        held.join(place, "trade_date").join(later, "ord").selectExpr("entity", "next_date AS trade_date", "target_weight")
    )
    gross = (
        carried.join(returns, ["entity", "trade_date"], "left")
        .groupBy("trade_date")
        .agg(F.expr("sum(target_weight * coalesce(ret, 0.0D)) AS gross_return"))
    )
    done = order_rows.filter("weight_after = new_weight").selectExpr("*", "abs(new_weight - old_weight) AS moved")
    changes = done.groupBy(F.expr("execution_date AS trade_date")).agg(
        F.expr("sum(moved) AS turnover"),
        F.expr("coalesce(sum(moved) FILTER (WHERE side = 'sell'), 0.0D) AS sold"),
    )
    bps = rules["commission_bps"] + rules["slippage_bps"]
    days = open_days(calendar).filter(f"trade_date >= DATE'{start}'")
    return (
        days.join(gross, "trade_date", "left")
        .join(changes, "trade_date", "left")
        .selectExpr(
            "trade_date",
            "coalesce(gross_return, 0.0D) AS gross_return",
            "coalesce(turnover, 0.0D) AS turnover",
            f"coalesce(turnover * {bps}D / 10000 + sold * {rules['stamp_tax_bps']}D / 10000, 0.0D) AS cost_drag",
        )
        .selectExpr("*", "gross_return - cost_drag AS net_return")
    )


def metrics(
    curve: DataFrame, benchmark: DataFrame, rebalances: DataFrame, ledger: DataFrame, exits: DataFrame, rules: dict = TRADING
) -> DataFrame:
    """One row of performance, cost and comparison figures.

    ``curve`` has trade_date, net_return, nav and drawdown; its first day does
    not enter the return statistics.
    """
    initial, year = rules["initial_cash"], rules["trading_days_per_year"]
    numbered = curve.selectExpr("*", "row_number() OVER (ORDER BY trade_date) AS i", "count(*) OVER () AS n")
    stat = "CASE WHEN i > 1 OR n = 1 THEN net_return END"
    c = numbered.agg(
        F.expr("max_by(nav, trade_date) AS final_nav"),
        F.expr("count(*) AS days"),
        F.expr(f"avg({stat}) AS mean_return"),
        F.expr(f"CASE WHEN count({stat}) > 1 THEN stddev_samp({stat}) END AS sd"),
        F.expr(f"avg(CAST(({stat}) > 0 AS INT)) AS win_rate"),
        F.expr("min(drawdown) AS max_drawdown"),
    )
    b = benchmark.agg(
        F.expr("max_by(cap_nav, trade_date) - 1 AS cap_return"), F.expr("max_by(equal_nav, trade_date) - 1 AS equal_return")
    )
    r = rebalances.agg(
        F.expr("coalesce(avg(one_way_turnover), 0.0D) AS average_turnover"),
        F.expr("coalesce(max(one_way_turnover), 0.0D) AS max_turnover"),
        F.expr("CAST(count(*) AS DOUBLE) AS rebalance_count"),
    )
    sums = ("total_cost", "commission", "stamp_tax", "slippage_cost")
    led = ledger.agg(
        *[F.expr(f"coalesce(sum({x}), 0.0D) AS {x}") for x in sums],
        F.expr("count_if(order_status = 'executed') AS executed"),
        F.expr("CAST(count_if(order_status = 'rejected') AS DOUBLE) AS rejected_order_count"),
    )
    x = exits.agg(F.expr("count(*) AS forced"))
    # Five single-row aggregates, stacked and folded into one row.
    parts = c
    for other in (b, r, led, x):
        parts = parts.unionByName(other, allowMissingColumns=True)
    one = parts.agg(*[F.max(name).alias(name) for name in parts.columns])
    net = f"final_nav / {initial}D - 1"
    gross = f"(final_nav + total_cost) / {initial}D - 1"
    annual = f"CASE WHEN final_nav <= 0 THEN -1.0D ELSE pow(final_nav / {initial}D, {year}D / days) - 1 END"
    return one.selectExpr("*", f"{net} AS net", f"{gross} AS gross", f"{annual} AS annual").selectExpr(
        "net AS total_return",
        "annual AS annualized_return",
        f"coalesce(sd * sqrt({year}D), 0.0D) AS volatility",
        "max_drawdown",
        f"CASE WHEN sd > 0 THEN mean_return / sd * sqrt({year}D) ELSE 0.0D END AS sharpe",
        "CASE WHEN max_drawdown < 0 THEN annual / abs(max_drawdown) ELSE 0.0D END AS calmar",
        "coalesce(win_rate, 0.0D) AS win_rate",
        "gross AS gross_return",
        "net AS net_return",
        "gross - net AS cost_drag",
        *sums,
        "average_turnover",
        "max_turnover",
        "cap_return AS benchmark_cap_weight_return",
        "equal_return AS benchmark_equal_weight_return",
        "net - cap_return AS excess_return_vs_cap_weight",
        "net - equal_return AS excess_return_vs_equal_weight",
        "net - cap_return AS tracking_difference_vs_cap_weight",
        "net - equal_return AS tracking_difference_vs_equal_weight",
        "rebalance_count",
        "CAST(executed + forced AS DOUBLE) AS trade_count",
        "rejected_order_count",
        "CAST(forced AS DOUBLE) AS forced_delist_exit_count",
    )


def constraint_summary(ledger: DataFrame) -> DataFrame:
    """Order counts per status and reason, with a row for each status that has none."""
    counts = ledger.groupBy("order_status", F.expr("coalesce(reject_reason, '') AS reject_reason")).agg(
        F.expr("count(*) AS order_count")
    )
    expected = ledger.sparkSession.range(1).selectExpr(
        "explode(array('executed', 'rejected', 'forced_delist_exit')) AS order_status"
    )
    return expected.join(counts, "order_status", "full_outer").selectExpr(
        "order_status", "coalesce(reject_reason, '') AS reject_reason", "coalesce(order_count, 0) AS order_count"
    )
