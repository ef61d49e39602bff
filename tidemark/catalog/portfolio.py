"""K: portfolio analytics."""

from __future__ import annotations

from tidemark.catalog.factors import factor_rows
from tidemark.catalog.registry import CTES, cte, query
from tidemark.functions.calendar import month_ends
from tidemark.operators import asof
from tidemark.operators import portfolio as pf
from tidemark.operators import selection as se
from tidemark.params import HARD_FILTERS, TRADING
from tidemark.session import materialize

START, END = "1996-06-01", "2001-10-08"
NAV = TRADING["initial_cash"]
SORT, TOP_N = "return_20d", 10
_IN = f"trade_date BETWEEN DATE '{START}' AND DATE '{END}'"


NAMES = [SORT, *HARD_FILTERS]


def replay_rows(t):
    """Factor rows on the month ends of the replay range, shared by all replay queries."""
    days = month_ends(t.calendar, START, END).selectExpr("signal_date AS trade_date")
    return t.stored("replay_rows", lambda: factor_rows(t, NAMES, days))


def targets(t):
    """Month-end top-N targets inside the replay range."""
    return t.stored("replay_targets", lambda: se.equal_weight_targets(se.to_wide(replay_rows(t), NAMES), SORT, TOP_N))


def executable(t):
    """Scheduled signals that can be executed: factor rows are there, and a next open day inside the range."""
    return pf.schedule(t.calendar, START, END, replay_rows(t).select("trade_date")).filter("skip_reason = ''")


# A month whose selection is empty, and weeks of a total and a more than total loss.
EMPTY = "signal_date BETWEEN DATE'1998-02-01' AND DATE'1998-02-28'"


def gapped(t):
    return targets(t).filter(f"NOT ({EMPTY})")


def signals(t):
    return month_ends(t.calendar_gaps, START, END).select("signal_date")


# SQL side: targets of the replay range
cte("km", f"SELECT max(trade_date) AS signal_date FROM cal WHERE {_IN} GROUP BY date_trunc('month', trade_date)", ["cal"])
_FILTER_COLS = ", ".join(f"max(CASE WHEN factor_name = '{n}' THEN factor_value END) AS {n}" for n in [SORT, *HARD_FILTERS])
_PASS = " AND ".join(f"coalesce({n} = 0, FALSE)" for n in HARD_FILTERS)
cte(
    "kt",
    f"""SELECT signal_date, entity, target_weight FROM (
          SELECT trade_date AS signal_date, entity, 1.0 / count(*) OVER (PARTITION BY trade_date) AS target_weight
          FROM (SELECT * FROM (SELECT entity, trade_date, {_FILTER_COLS}
                 FROM ({' UNION ALL '.join(f'SELECT * FROM f_{n}' for n in [SORT, *HARD_FILTERS])})
                 WHERE trade_date IN (SELECT signal_date FROM km) GROUP BY 1, 2) WHERE {_PASS} AND {SORT} IS NOT NULL
                QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY {SORT} DESC, entity) <= {TOP_N}))""",
    ["km", *[f"f_{n}" for n in [SORT, *HARD_FILTERS]]],
)
_WITH_ROWS = " UNION ALL ".join(f"SELECT trade_date FROM f_{n}" for n in [SORT, *HARD_FILTERS])
cte(
    "ks",
    f"""SELECT signal_date, execution_date, lead(execution_date) OVER (ORDER BY signal_date) AS next_execution,
              row_number() OVER (ORDER BY signal_date) AS k
       FROM (SELECT signal_date, (SELECT min(trade_date) FROM cal WHERE trade_date > signal_date) AS execution_date
             FROM (SELECT signal_date FROM km WHERE signal_date IN ({_WITH_ROWS})))
       WHERE execution_date <= DATE '{END}'""",
    ["km", "cal", *[f"f_{n}" for n in [SORT, *HARD_FILTERS]]],
)
cte("kh", "SELECT kt.*, execution_date, next_execution, k FROM kt JOIN ks USING (signal_date) WHERE execution_date IS NOT NULL", ["kt", "ks"])
cte(
    "ko",
    f"""SELECT s.signal_date, s.execution_date, m.entity, m.old_weight, m.new_weight,
               CASE WHEN new_weight > old_weight THEN 'buy' ELSE 'sell' END AS side,
               abs(new_weight - old_weight) * {NAV} AS intended_notional, old_weight * {NAV} AS held_notional
        FROM (SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.k, b.k + 1) AS k,
                     coalesce(a.target_weight, 0) AS new_weight, coalesce(b.target_weight, 0) AS old_weight
              FROM kh a FULL OUTER JOIN kh b ON a.entity = b.entity AND a.k = b.k + 1) m
        JOIN ks s ON s.k = m.k AND s.execution_date IS NOT NULL WHERE abs(new_weight - old_weight) > 1e-12""",
    ["kh", "ks"],
)
cte(
    "kc",
    """SELECT o.*, p.open,
              CASE WHEN side = 'buy' AND x.delist_date <= o.execution_date
                        AND coalesce(x.delist_effective, x.delist_date) <= o.execution_date THEN 'delisted'
                   WHEN p.entity IS NULL THEN 'missing_daily_price' WHEN coalesce(p.open, 0) <= 0 THEN 'missing_or_invalid_open'
                   WHEN p.is_suspended THEN 'suspended'
                   WHEN side = 'buy' AND p.open >= p.limit_up - 0.000001 THEN 'limit_up'
                   WHEN side = 'sell' AND p.open <= p.limit_down + 0.000001 THEN 'limit_down' END AS reject_reason
       FROM ko o LEFT JOIN panel p ON p.entity = o.entity AND p.trade_date = o.execution_date
       LEFT JOIN securities x ON x.entity = o.entity""",
    ["ko", "panel", "securities"],
)
cte(
    "kl",
    """SELECT signal_date, execution_date, entity, side, CASE WHEN ok THEN 'executed' ELSE 'rejected' END AS order_status,
              CASE WHEN NOT ok THEN coalesce(reject_reason, 'below_board_lot') END AS reject_reason, intended_notional,
              CASE WHEN ok THEN shares * price ELSE 0 END AS executed_notional, CASE WHEN ok THEN price ELSE 0 END AS executed_price,
              CASE WHEN ok THEN CASE WHEN side = 'buy' THEN shares ELSE -shares END ELSE 0 END AS shares_delta,
              CASE WHEN ok THEN greatest(shares * price * 0.00025, 5.0) ELSE 0 END AS commission,
              CASE WHEN ok AND side = 'sell' THEN shares * price * 0.001 ELSE 0 END AS stamp_tax,
              CASE WHEN ok THEN abs(shares * price - shares * open) ELSE 0 END AS slippage_cost
       FROM (SELECT *, coalesce(shares, 0) > 1e-12 AS ok FROM (
         SELECT *, CASE WHEN reject_reason IS NOT NULL THEN 0 WHEN side = 'buy' THEN floor(req / 100) * 100
                        WHEN req >= held - 1e-9 THEN held
                        WHEN held - floor(held / 100) * 100 > 1e-9
                             AND floor(req / 100) * 100 + held - floor(held / 100) * 100 <= req + 1e-9
                             THEN least(floor(req / 100) * 100 + held - floor(held / 100) * 100, held)
                        WHEN floor(req / 100) * 100 <= 1e-12 AND held - floor(held / 100) * 100 <= req + 1e-9
                             THEN held - floor(held / 100) * 100
                        ELSE least(floor(req / 100) * 100, held) END AS shares
         FROM (SELECT *, CASE WHEN side = 'buy' THEN intended_notional / price ELSE least(held, intended_notional / open) END AS req
               FROM (SELECT *, open * CASE WHEN side = 'buy' THEN 1.0005 ELSE 0.9995 END AS price,
                            held_notional / nullif(open, 0) AS held FROM kc))))""",
    ["kc"],
)
cte("kth", f"SELECT * FROM kh WHERE NOT ({EMPTY})", ["kh"])
cte("kog", CTES["ko"][1].replace("kh ", "kth "), ["kth", "ks"])
cte("kcg", CTES["kc"][1].replace("ko o", "kog o"), ["kog", "panel", "securities"])
cte("kld", "SELECT *, commission + stamp_tax + slippage_cost AS total_cost FROM kl", ["kl"])
cte(
    "kx",
    """SELECT h.entity, h.signal_date, min(c.trade_date) AS exit_date, h.target_weight, 'forced_delist_exit' AS order_status
       FROM kh h JOIN securities x ON x.entity = h.entity AND x.delist_date IS NOT NULL
       JOIN cal c ON c.trade_date >= h.execution_date AND (h.next_execution IS NULL OR c.trade_date < h.next_execution)
        AND c.trade_date >= x.delist_date AND c.trade_date >= coalesce(x.delist_effective, x.delist_date)
       GROUP BY 1, 2, 4""",
    ["kh", "securities", "cal"],
)
# Orders against what is held: every execution day starts from the weights that the one before left.
cte(
    "kho",
    f"""WITH RECURSIVE cand AS MATERIALIZED (
          SELECT e.entity, s.k, s.signal_date, s.execution_date, coalesce(h.target_weight, 0)::DOUBLE AS target, p.open,
                 coalesce(x.delist_date <= s.execution_date AND coalesce(x.delist_effective, x.delist_date) <= s.execution_date, FALSE) AS gone,
                 coalesce(p.open > 0 AND NOT p.is_suspended, FALSE) AS trades,
                 coalesce(p.open >= p.limit_up - 0.000001, FALSE) AS at_top, coalesce(p.open <= p.limit_down + 0.000001, FALSE) AS at_bottom
          FROM (SELECT DISTINCT entity FROM kh) e JOIN ks s ON s.execution_date IS NOT NULL
          LEFT JOIN kh h ON h.entity = e.entity AND h.k = s.k
          LEFT JOIN panel p ON p.entity = e.entity AND p.trade_date = s.execution_date LEFT JOIN securities x ON x.entity = e.entity
        ), book AS (
          SELECT DISTINCT entity, 0::BIGINT AS k, NULL::DATE AS signal_date, NULL::DATE AS execution_date, 0::DOUBLE AS old_weight,
                 0::DOUBLE AS new_weight, 0::DOUBLE AS weight_after FROM kh
          UNION ALL
          SELECT entity, k, signal_date, execution_date, old, target,
                 CASE WHEN abs(target - old) > 1e-12 AND trades AND NOT (target > old AND (gone OR at_top)) AND NOT (target < old AND at_bottom)
                       AND CASE WHEN target > old THEN (target - old) * {NAV} / (open * 1.0005) >= 100
                                ELSE target * {NAV} / open <= 1e-9 OR (old - target) * {NAV} / open >= 100
                                     OR (old * {NAV} / open) % 100 <= (old - target) * {NAV} / open + 1e-9 END
                      THEN target ELSE old END
          FROM (SELECT c.*, CASE WHEN c.gone THEN 0 ELSE b.weight_after END AS old FROM book b JOIN cand c ON c.entity = b.entity AND c.k = b.k + 1)
        )
        SELECT signal_date, execution_date, entity, old_weight, new_weight, CASE WHEN new_weight > old_weight THEN 'buy' ELSE 'sell' END AS side,
               abs(new_weight - old_weight) * {NAV} AS intended_notional, old_weight * {NAV} AS held_notional, weight_after
        FROM book WHERE k > 0 AND abs(new_weight - old_weight) > 1e-12""",
    ["kh", "ks", "panel", "securities"],
)
cte("khc", CTES["kc"][1].replace("ko o", "kho o"), ["kho", "panel", "securities"])
cte("khl", CTES["kl"][1].replace("FROM kc", "FROM khc"), ["khc"])
cte("khld", CTES["kld"][1].replace("FROM kl", "FROM khl"), ["khl"])
cte(
    "khp",
    """SELECT * FROM (SELECT entity, signal_date, execution_date, new_weight AS target_weight,
                             lead(execution_date) OVER (PARTITION BY entity ORDER BY execution_date) AS next_execution
                      FROM kho WHERE weight_after = new_weight) WHERE target_weight > 0""",
    ["kho"],
)
cte("khx", CTES["kx"][1].replace("FROM kh h", "FROM khp h"), ["khp", "securities", "cal"])
cte(
    "khd",
    """SELECT h.entity, h.target_weight, c.trade_date FROM khp h LEFT JOIN khx x ON x.entity = h.entity AND x.signal_date = h.signal_date
       JOIN cal c ON c.trade_date >= h.execution_date AND c.trade_date < coalesce(x.exit_date, h.next_execution, DATE '9999-12-31')""",
    ["khp", "khx", "cal"],
)
cte(
    "kd",
    """SELECT h.entity, h.signal_date, h.execution_date, h.target_weight, c.trade_date FROM kh h
       JOIN cal c ON c.trade_date >= h.execution_date AND (h.next_execution IS NULL OR c.trade_date < h.next_execution)""",
    ["kh", "cal"],
)
cte(
    "krb",
    f"""SELECT *, (buy_notional + sell_notional) / {NAV} AS gross_turnover, (buy_notional + sell_notional) / {NAV} / 2 AS one_way_turnover
        FROM (SELECT signal_date, execution_date,
                coalesce(sum(executed_notional) FILTER (WHERE order_status = 'executed' AND side = 'buy'), 0) AS buy_notional,
                coalesce(sum(executed_notional) FILTER (WHERE order_status = 'executed' AND side = 'sell'), 0) AS sell_notional,
                sum(commission) AS commission, sum(stamp_tax) AS stamp_tax, sum(slippage_cost) AS slippage_cost, sum(total_cost) AS total_cost,
                count(*) FILTER (WHERE order_status = 'executed') AS executed_order_count,
                count(*) FILTER (WHERE order_status = 'rejected') AS rejected_order_count FROM kld GROUP BY 1, 2)""",
    ["kld"],
)
cte("khrb", CTES["krb"][1].replace("FROM kld", "FROM khld"), ["khld"])
cte(
    "kmg",
    f"SELECT max(trade_date) AS signal_date FROM calgap WHERE is_open AND {_IN} GROUP BY date_trunc('month', trade_date)",
    ["calgap"],
)
cte(
    "klock",
    f"""SELECT c.trade_date, coalesce((SELECT max(signal_date) FROM kmg WHERE signal_date <= c.trade_date),
                                      (SELECT least(min(signal_date), DATE '{START}') FROM kmg)) AS lock_date
        FROM calgap c WHERE is_open AND trade_date >= DATE '{START}'""",
    ["calgap", "kmg"],
)
cte(
    "kw",
    """SELECT lock_date, entity, member_count, CASE WHEN s > 0 THEN coalesce(cap, 0) / s ELSE 1.0 / member_count END AS cap_weight,
              1.0 / member_count AS equal_weight
       FROM (SELECT *, sum(cap) OVER (PARTITION BY lock_date) AS s, count(*) OVER (PARTITION BY lock_date) AS member_count
             FROM (SELECT l.lock_date, m.entity, CASE WHEN coalesce(p.float_mv, p.total_mv) > 0 THEN coalesce(p.float_mv, p.total_mv) END AS cap
                   FROM (SELECT DISTINCT lock_date FROM klock) l
                   JOIN members m ON m.in_date <= l.lock_date AND coalesce(m.in_effective, m.in_date) <= l.lock_date
                     AND (m.out_date IS NULL OR l.lock_date < m.out_date OR coalesce(m.out_effective, m.out_date) > l.lock_date)
                   LEFT JOIN panel p ON p.entity = m.entity AND p.trade_date = l.lock_date))""",
    ["klock", "members", "panel"],
)
cte(
    "kret",
    """SELECT a.entity, a.trade_date,
              CASE WHEN NOT a.is_suspended AND a.close > 0 AND b.close > 0
                   THEN (a.close * coalesce(a.adj_factor, 1)) / (b.close * coalesce(b.adj_factor, 1)) - 1 END AS ret
       FROM panel a JOIN gords o ON o.trade_date = a.trade_date
       LEFT JOIN gords q ON q.ord = o.ord - 1 LEFT JOIN panel b ON b.entity = a.entity AND b.trade_date = q.trade_date""",
    ["panel", "gords"],
)
for _w in ("cap", "equal"):
    cte(
        f"kb_{_w}",
        f"""SELECT l.trade_date, CASE WHEN l.trade_date = (SELECT min(trade_date) FROM klock) THEN 0.0
                     ELSE coalesce(sum(w.{_w}_weight * coalesce(r.ret, 0)), 0) END AS portfolio_return,
                   CASE WHEN count(w.entity) = 0 THEN 0.0 WHEN l.trade_date = (SELECT min(trade_date) FROM klock) THEN 1.0
                        ELSE count(r.ret) / count(w.entity) END AS coverage, count(w.entity) AS member_count
            FROM klock l LEFT JOIN kw w ON w.lock_date = l.lock_date
            LEFT JOIN kret r ON r.entity = w.entity AND r.trade_date = l.trade_date GROUP BY l.trade_date""",
        ["klock", "kw", "kret"],
    )
cte(
    "knav",
    """SELECT c.trade_date, c.portfolio_return AS cap_return, e.portfolio_return AS equal_return,
              product(1 + c.portfolio_return) OVER (ORDER BY c.trade_date) AS cap_nav,
              product(1 + e.portfolio_return) OVER (ORDER BY c.trade_date) AS equal_nav
       FROM kb_cap c JOIN kb_equal e ON e.trade_date = c.trade_date""",
    ["kb_cap", "kb_equal"],
)
cte(
    "kretc",
    """SELECT a.entity, a.trade_date,
              CASE WHEN NOT a.is_suspended AND a.close > 0 AND b.close > 0
                   THEN (a.close * coalesce(a.adj_factor, 1)) / (b.close * coalesce(b.adj_factor, 1)) - 1 END AS ret
       FROM panel a JOIN ords o ON o.trade_date = a.trade_date
       LEFT JOIN ords q ON q.ord = o.ord - 1 LEFT JOIN panel b ON b.entity = a.entity AND b.trade_date = q.trade_date""",
    ["panel", "ords"],
)
cte(
    "kp",
    f"""SELECT c.trade_date, coalesce(g.gross_return, 0) AS gross_return, coalesce(o.turnover, 0) AS turnover,
               coalesce(o.turnover * 0.00075 + o.sold * 0.001, 0) AS cost_drag,
               coalesce(g.gross_return, 0) - coalesce(o.turnover * 0.00075 + o.sold * 0.001, 0) AS net_return
        FROM (SELECT trade_date FROM cal WHERE trade_date >= DATE '{START}') c
        LEFT JOIN (SELECT b.trade_date, sum(h.target_weight * coalesce(r.ret, 0)) AS gross_return
                   FROM khd h JOIN ords a ON a.trade_date = h.trade_date JOIN ords b ON b.ord = a.ord + 1
                   LEFT JOIN kretc r ON r.entity = h.entity AND r.trade_date = b.trade_date GROUP BY 1) g ON g.trade_date = c.trade_date
        LEFT JOIN (SELECT execution_date, sum(abs(new_weight - old_weight)) AS turnover,
                          coalesce(sum(abs(new_weight - old_weight)) FILTER (WHERE side = 'sell'), 0) AS sold
                   FROM kho WHERE weight_after = new_weight GROUP BY 1) o ON o.execution_date = c.trade_date""",
    ["cal", "khd", "ords", "kretc", "kho"],
)
cte(
    "kcurve",
    f"""SELECT *, nav / greatest({NAV}, max(nav) OVER (ORDER BY trade_date)) - 1 AS drawdown
        FROM (SELECT *, {NAV} * product(1 + net_return) OVER (ORDER BY trade_date) AS nav FROM kp)""",
    ["kp"],
)


@query("k1_month_end_signals", "SELECT signal_date FROM kmg", ["kmg"])
def _(t):
    return signals(t)


@query(
    "k2_next_open_dates",
    f"""SELECT signal_date, next_open, CASE WHEN next_open <= DATE '{END}' THEN next_open END AS execution_date
        FROM (SELECT trade_date AS signal_date, (SELECT min(trade_date) FROM calgap x WHERE x.is_open AND x.trade_date > c.trade_date) AS next_open
              FROM calgap c)""",
    ["calgap"],
)
def _(t):
    return pf.bounded_execution(t.calendar_gaps.selectExpr("trade_date AS signal_date"), t.calendar_gaps, END)


@query(
    "k3_rebalance_schedule",
    f"""SELECT signal_date, execution_date,
               CASE WHEN execution_date IS NULL THEN 'execution_date does not exist'
                    WHEN execution_date > DATE '{END}' THEN 'execution_date after end_date'
                    WHEN signal_date NOT IN (SELECT trade_date FROM f_return_60d) THEN 'no factor rows' ELSE '' END AS skip_reason
        FROM (SELECT signal_date, (SELECT min(trade_date) FROM cal WHERE trade_date > signal_date) AS execution_date
              FROM (SELECT max(trade_date) AS signal_date FROM cal WHERE trade_date BETWEEN DATE '1995-06-01' AND DATE '{END}'
                    GROUP BY date_trunc('month', trade_date)))""",
    ["cal", "f_return_60d"],
)
def _(t):
    return pf.schedule(t.calendar, "1995-06-01", END, factor_rows(t, ["return_60d"]).select("trade_date"))


@query(
    "k4_target_notional",
    f"SELECT signal_date, entity, target_weight, greatest(target_weight * {NAV}, 0) AS target_notional FROM kt",
    ["kt"],
    doubles="target_weight target_notional",
)
def _(t):
    return pf.target_notional(targets(t), NAV).select("signal_date", "entity", "target_weight", "target_notional")


def classified(t, tg=None):
    rows = pf.orders(targets(t) if tg is None else tg, t.calendar, NAV, executable(t))
    return pf.classify_orders(rows, t.prices, t.securities)


@query(
    "k5_order_feasibility",
    "SELECT * FROM kc",
    ["kc"],
    doubles="old_weight new_weight intended_notional held_notional open",
)
def _(t):
    return classified(t)


@query(
    "k5_order_feasibility_empty_month",
    "SELECT * FROM kcg",
    ["kcg"],
    doubles="old_weight new_weight intended_notional held_notional open",
)
def _(t):
    return classified(t, gapped(t))


@query("k6_forced_delist_exits", "SELECT * FROM kx", ["kx"], doubles="target_weight")
def _(t):
    return pf.forced_exits(targets(t), t.securities, t.calendar, executable(t))


@query(
    "k7_order_ledger",
    "SELECT * FROM kld",
    ["kld"],
    doubles="intended_notional executed_notional executed_price shares_delta commission stamp_tax slippage_cost total_cost",
)
def _(t):
    return pf.execute_orders(classified(t))


@query(
    "k8_mark_to_market",
    """SELECT signal_date, trade_date, entity, coalesce(target_weight * 1000 / paid, 0) AS shares, coalesce(lc, 0) AS close,
               coalesce(target_weight * 1000 / paid, 0) * coalesce(lc, 0) AS market_value,
               CASE WHEN px IS NULL THEN 'last_visible_close' ELSE 'daily_close' END AS price_source
        FROM (SELECT h.*, p.close AS px, x.open AS paid, last_value(p.close IGNORE NULLS) OVER (PARTITION BY h.entity ORDER BY h.trade_date
                     ROWS UNBOUNDED PRECEDING) AS lc
              FROM kd h LEFT JOIN panel p ON p.entity = h.entity AND p.trade_date = h.trade_date AND p.close > 0
              LEFT JOIN panel x ON x.entity = h.entity AND x.trade_date = h.execution_date AND x.open > 0)""",
    ["kd", "panel"],
    doubles="shares close market_value",
)
def _(t):
    return pf.mark_to_market(pf.holdings(targets(t), t.calendar, executable(t)), t.prices, 1000.0)


_RB_DOUBLES = (
    "buy_notional sell_notional commission stamp_tax slippage_cost total_cost gross_turnover one_way_turnover"
)


@query("k9_rebalance_summary", "SELECT * FROM krb", ["krb"], doubles=_RB_DOUBLES)
def _(t):
    return pf.rebalance_summary(pf.execute_orders(classified(t)), NAV)


def locks(t):
    return t.stored("basket_locks", lambda: pf.lock_dates(t.calendar_gaps, signals(t), START))


def weights(t):
    lock_days = locks(t).selectExpr("lock_date AS trade_date").distinct()
    return t.stored(
        "basket_weights", lambda: pf.basket_weights(asof.intervals_on_dates(t.members, lock_days), t.valuations)
    )


def basket(t, weight):
    returns = t.stored("basket_day_returns", lambda: pf.daily_returns(t.prices, t.calendar_gaps))
    return pf.basket_returns(locks(t), weights(t), returns, weight)


def benchmark_nav(t):
    cap = basket(t, "cap_weight").selectExpr("trade_date", "portfolio_return AS cap_return")
    equal = basket(t, "equal_weight").selectExpr("trade_date", "portfolio_return AS equal_return")
    both = pf.with_nav(cap.join(equal, "trade_date"), "cap_return", out="cap_nav")
    return pf.with_nav(both, "equal_return", out="equal_nav")


@query("k10_benchmark_weights", "SELECT * FROM kw", ["kw"], doubles="cap_weight equal_weight")
def _(t):
    return weights(t)


@query("k11_lock_dates", "SELECT * FROM klock", ["klock"])
def _(t):
    return locks(t)


@query(
    "k12_basket_returns",
    "SELECT *, 'cap' AS weighting FROM kb_cap UNION ALL SELECT *, 'equal' FROM kb_equal",
    ["kb_cap", "kb_equal"],
    doubles="portfolio_return coverage",
)
def _(t):
    cap = basket(t, "cap_weight").selectExpr("*", "'cap' AS weighting")
    return cap.unionByName(basket(t, "equal_weight").selectExpr("*", "'equal' AS weighting"))


# Weekly returns of the derived panel compound to astronomic values, so the
# queries show NAVs and return totals on a signed log scale.
def slog(column: str) -> str:
    return f"sign({column}) * ln(1 + abs({column}))"


@query(
    "k13_benchmark_nav",
    f"SELECT trade_date, cap_return, equal_return, {slog('cap_nav')} AS log_cap_nav, {slog('equal_nav')} AS log_equal_nav FROM knav",
    ["knav"],
    doubles="cap_return equal_return log_cap_nav log_equal_nav",
)
def _(t):
    return benchmark_nav(t).selectExpr(
        "trade_date", "cap_return", "equal_return", f"{slog('cap_nav')} AS log_cap_nav", f"{slog('equal_nav')} AS log_equal_nav"
    )


_LOSSES = "CASE WHEN trade_date = DATE'1999-03-01' THEN -1.5D WHEN trade_date = DATE'2000-05-01' THEN -1.0D ELSE portfolio_return END"


@query(
    "k13_nav_with_losses",
    f"""SELECT trade_date, portfolio_return, {slog('nav')} AS log_nav
        FROM (SELECT *, product(1 + portfolio_return) OVER (ORDER BY trade_date) AS nav FROM (
          SELECT trade_date, CASE WHEN trade_date = DATE '1999-03-01' THEN -1.5 WHEN trade_date = DATE '2000-05-01' THEN -1.0
                             ELSE portfolio_return END AS portfolio_return FROM kb_equal))""",
    ["kb_equal"],
    doubles="portfolio_return log_nav",
)
def _(t):
    daily = basket(t, "equal_weight").selectExpr("trade_date", f"{_LOSSES} AS portfolio_return")
    return pf.with_nav(daily).selectExpr("trade_date", "portfolio_return", f"{slog('nav')} AS log_nav")


def book(t):
    """Orders against what is held, and the forced exits of what is held."""
    rows = t.stored("held_orders", lambda: pf.held_orders(targets(t), t.calendar, NAV, t.prices, t.securities, executable(t)))
    return rows, pf.exits_of(pf.held_periods(rows), t.securities, t.calendar)


def portfolio(t):
    returns = pf.daily_returns(t.prices, t.calendar)
    return pf.target_portfolio(*book(t), t.calendar, returns, START)


def curve(t):
    return pf.with_drawdown(pf.with_nav(portfolio(t), "net_return", NAV), NAV)


@query(
    "k14_held_orders",
    """SELECT o.*, l.order_status, l.reject_reason, l.total_cost FROM kho o JOIN khld l ON l.entity = o.entity AND l.execution_date = o.execution_date""",
    ["kho", "khld"],
    doubles="old_weight new_weight intended_notional held_notional weight_after total_cost",
)
def _(t):
    rows, _ = book(t)
    ledger = pf.execute_orders(pf.classify_orders(rows, t.prices, t.securities))
    return rows.join(ledger.select("entity", "execution_date", "order_status", "reject_reason", "total_cost"), ["entity", "execution_date"])


@query("k14_held_exits", "SELECT * FROM khx", ["khx"], doubles="target_weight")
def _(t):
    return book(t)[1]


@query(
    "k14_target_weight_portfolio",
    "SELECT * FROM kp",
    ["kp"],
    doubles="gross_return turnover cost_drag net_return",
)
def _(t):
    return portfolio(t)


@query(
    "k15_drawdown",
    f"SELECT trade_date, {slog('nav')} AS log_nav, drawdown FROM kcurve",
    ["kcurve"],
    doubles="log_nav drawdown",
)
def _(t):
    return curve(t).selectExpr("trade_date", f"{slog('nav')} AS log_nav", "drawdown")


_M = (
    "total_return annualized_return volatility max_drawdown sharpe calmar win_rate gross_return net_return cost_drag total_cost "
    "commission stamp_tax slippage_cost average_turnover max_turnover benchmark_cap_weight_return benchmark_equal_weight_return "
    "excess_return_vs_cap_weight excess_return_vs_equal_weight tracking_difference_vs_cap_weight "
    "tracking_difference_vs_equal_weight rebalance_count trade_count rejected_order_count forced_delist_exit_count"
)
cte(
    "kmetrics",
    f"""SELECT net AS total_return, annual AS annualized_return, coalesce(sd * sqrt(252), 0) AS volatility, max_drawdown,
               CASE WHEN sd > 0 THEN mu / sd * sqrt(252) ELSE 0 END AS sharpe,
               CASE WHEN max_drawdown < 0 THEN annual / abs(max_drawdown) ELSE 0 END AS calmar, win_rate,
               gross AS gross_return, net AS net_return, gross - net AS cost_drag, total_cost, commission, stamp_tax, slippage_cost,
               average_turnover, max_turnover, cap_return AS benchmark_cap_weight_return, equal_return AS benchmark_equal_weight_return,
               net - cap_return AS excess_return_vs_cap_weight, net - equal_return AS excess_return_vs_equal_weight,
               net - cap_return AS tracking_difference_vs_cap_weight, net - equal_return AS tracking_difference_vs_equal_weight,
               rebalance_count, executed + forced AS trade_count, rejected_order_count, forced AS forced_delist_exit_count
        FROM (SELECT *, nav / {NAV} - 1 AS net, (nav + total_cost) / {NAV} - 1 AS gross, pow(nav / {NAV}, 252.0 / days) - 1 AS annual
              FROM (SELECT arg_max(nav, trade_date) AS nav, count(*) AS days, min(drawdown) AS max_drawdown,
                           avg(CASE WHEN i > 1 THEN net_return END) AS mu, stddev_samp(CASE WHEN i > 1 THEN net_return END) AS sd,
                           avg(CASE WHEN i > 1 THEN CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END END) AS win_rate
                    FROM (SELECT *, row_number() OVER (ORDER BY trade_date) AS i FROM kcurve)),
                   (SELECT arg_max(cap_nav, trade_date) - 1 AS cap_return, arg_max(equal_nav, trade_date) - 1 AS equal_return FROM knav),
                   (SELECT avg(one_way_turnover) AS average_turnover, max(one_way_turnover) AS max_turnover, count(*) AS rebalance_count FROM khrb),
                   (SELECT sum(total_cost) AS total_cost, sum(commission) AS commission, sum(stamp_tax) AS stamp_tax,
                           sum(slippage_cost) AS slippage_cost, count(*) FILTER (WHERE order_status = 'executed') AS executed,
                           count(*) FILTER (WHERE order_status = 'rejected') AS rejected_order_count FROM khld),
                   (SELECT count(*) AS forced FROM khx))""",
    ["kcurve", "knav", "khrb", "khld", "khx"],
)


def metrics(t):
    rows, exits = book(t)
    ledger = materialize(pf.execute_orders(pf.classify_orders(rows, t.prices, t.securities)))
    return pf.metrics(curve(t), benchmark_nav(t), pf.rebalance_summary(ledger, NAV), ledger, exits)


# cost_drag is the gap of two totals; next to such totals it is below one ulp.
_SCALED = ", ".join(f"{slog(c)} AS {c}" for c in _M.split() if c != "cost_drag")


@query("k16_metrics", f"SELECT {_SCALED} FROM kmetrics", ["kmetrics"], doubles=_M.replace("cost_drag ", ""))
def _(t):
    return metrics(t).selectExpr(*[f"{slog(c)} AS {c}" for c in _M.split() if c != "cost_drag"])


@query(
    "k17_constraint_summary",
    """SELECT s.order_status, coalesce(l.reject_reason, '') AS reject_reason, count(l.entity) AS order_count
       FROM (VALUES ('executed'), ('rejected'), ('forced_delist_exit')) s(order_status)
       LEFT JOIN kld l ON l.order_status = s.order_status GROUP BY 1, 2""",
    ["kld"],
)
def _(t):
    return pf.constraint_summary(pf.execute_orders(classified(t)))
