"""F: universe snapshots and resolution."""

from __future__ import annotations

import uuid

from tidemark.catalog.factors import factor_rows
from tidemark.catalog.registry import cte, query
from tidemark.functions.calendar import month_ends, open_days
from tidemark.operators import validation as va
from tidemark.session import shared_dir
from tidemark.operators import asof
from tidemark.operators import universe as un

cte(
    "snap",
    """
    SELECT 'run_a' AS source_run_id, trade_date, trade_date AS as_of_date, index_code, entity,
           'universe_members' AS universe_source, 'main' AS source, coalesce(source_tag, 'fallback') AS source_tag,
           coalesce(universe_kind, 'unknown') AS universe_kind
    FROM (SELECT m.*, d.trade_date FROM members m JOIN monthends d
            ON m.in_date <= d.trade_date AND coalesce(m.in_effective, m.in_date) <= d.trade_date
           AND (m.out_date IS NULL OR d.trade_date < m.out_date OR coalesce(m.out_effective, m.out_date) > d.trade_date))
    """,
    ["members", "monthends"],
)


def signals(t):
    return month_ends(t.calendar).selectExpr("signal_date AS trade_date")


def snapshot(t, run_id="run_a", dates=None):
    return un.snapshot_rows(t.members, signals(t) if dates is None else dates, run_id, "X", "fallback")


@query("f1_write_snapshot", "SELECT * FROM snap", ["snap"])
def _(t):
    """Two runs written one after the other to one store, the second replaced; read back as stored."""
    path, cols = f"{shared_dir(t.spark)}/snapshots-{uuid.uuid4().hex}", snapshot(t).columns
    un.write_snapshot(snapshot(t), path)
    un.write_snapshot(snapshot(t, "run_b"), path)
    un.write_snapshot(snapshot(t, "run_b").limit(1), path)
    return t.spark.read.schema(snapshot(t).schema).parquet(path).filter("source_run_id = 'run_a'").select(*cols)


@query(
    "f2_load_snapshot",
    "SELECT * FROM snap WHERE trade_date BETWEEN DATE '1999-11-01' AND DATE '1999-11-30' AND index_code = 'X'",
    ["snap"],
)
def _(t):
    store = snapshot(t)
    return un.load_snapshot(store, "run_a", None, "X").filter(
        "trade_date BETWEEN DATE'1999-11-01' AND DATE'1999-11-30'"
    )


def fingerprint_sql(source: str, groups: str) -> str:
    words = ", ".join(
        f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS BIGINT) AS w{i}" for i in range(8)
    )
    text = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in ["member_count", *[f"w{i}" for i in range(8)]])
    return f"""
    SELECT {groups}, member_count, sha256({text}) AS fingerprint
    FROM (SELECT {groups}, count(*) AS member_count, {words}
          FROM (SELECT DISTINCT {groups}, entity, sha256(CAST(entity AS VARCHAR)) AS h FROM {source}) GROUP BY {groups})
    """


def names_sql(source: str, column: str) -> str:
    """Scalar: fingerprint of the distinct values of a column, NULL when there are none."""
    words = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS BIGINT) AS w{i}" for i in range(8))
    text = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in ["n", *[f"w{i}" for i in range(8)]])
    return f"""(SELECT CASE WHEN n > 0 THEN sha256({text}) END FROM (SELECT count(*) AS n, {words}
        FROM (SELECT DISTINCT {column}, sha256(CAST({column} AS VARCHAR)) AS h FROM {source} WHERE {column} IS NOT NULL)))"""


@query("f3_fingerprint_per_date", fingerprint_sql("snap", "source_run_id, trade_date"), ["snap"])
def _(t):
    return un.set_fingerprint(snapshot(t), ["source_run_id", "trade_date"], "entity")


@query("f3_fingerprint_per_run", fingerprint_sql("snap", "source_run_id"), ["snap"])
def _(t):
    return un.set_fingerprint(snapshot(t), ["source_run_id"], "entity")


@query(
    "f4_drop_run",
    "SELECT source_run_id, count(*) AS n FROM (SELECT 'run_b' AS source_run_id FROM snap) GROUP BY 1",
    ["snap"],
)
def _(t):
    store = snapshot(t).unionByName(snapshot(t, "run_b"))
    return un.drop_run(store, "run_a").groupBy("source_run_id").count().withColumnRenamed("count", "n")


cte(
    "resolved",
    """
    SELECT trade_date, entity, universe_source FROM (
      SELECT *, min(p) OVER (PARTITION BY trade_date) AS best FROM (
        SELECT DISTINCT trade_date, entity, 0 AS p, 'factor_run_universe' AS universe_source FROM snap
          WHERE trade_date < DATE '1997-01-01'
        UNION ALL SELECT DISTINCT trade_date, entity, 1, 'hard_filters' FROM f_low_liquidity
          WHERE trade_date < DATE '1999-01-01' AND trade_date IN (SELECT trade_date FROM monthends)
        UNION ALL SELECT DISTINCT trade_date, entity, 2, 'factor_values_fallback' FROM f_return_20d
          WHERE trade_date IN (SELECT trade_date FROM monthends)))
    WHERE p = best
    """,
    ["snap", "f_low_liquidity", "f_return_20d", "monthends"],
)


def resolved(t):
    rows = factor_rows(t, ["return_20d", "low_liquidity"], signals(t))
    flags = rows.filter("factor_name = 'low_liquidity' AND trade_date < DATE'1999-01-01'")
    return un.first_available(
        [
            ("factor_run_universe", snapshot(t).filter("trade_date < DATE'1997-01-01'")),
            ("hard_filters", flags),
            ("factor_values_fallback", rows.filter("factor_name = 'return_20d'")),
        ]
    )


@query("f5_resolve_universe", "SELECT * FROM resolved", ["resolved"])
def _(t):
    return resolved(t)


cte(
    "coversrc",
    """SELECT d.trade_date, 'return_20d' AS factor_name, coalesce(u.n, 0) AS universe_count, coalesce(v.n, 0) AS valid_factor_count,
              coalesce(u.src, 'missing') AS universe_source, greatest(coalesce(u.n, 0) - coalesce(v.n, 0), 0) AS missing_count,
              coalesce(v.n, 0) / nullif(u.n, 0) AS coverage, 1 - coalesce(v.n, 0) / nullif(u.n, 0) AS missing_rate
       FROM monthends d
       LEFT JOIN (SELECT trade_date, count(DISTINCT entity) AS n, min(universe_source) AS src FROM resolved GROUP BY 1) u ON u.trade_date = d.trade_date
       LEFT JOIN (SELECT trade_date, count(DISTINCT entity) AS n FROM f_return_20d GROUP BY 1) v ON v.trade_date = d.trade_date""",
    ["monthends", "resolved", "f_return_20d"],
)


def covered_by_source(t):
    rows = factor_rows(t, ["return_20d"], signals(t))
    return va.coverage(rows, resolved(t), signals(t), ["return_20d"])


@query("g5_coverage_by_source", "SELECT * FROM coversrc", ["coversrc"], doubles="coverage missing_rate")
def _(t):
    return covered_by_source(t)


@query(
    "g5_coverage_warnings",
    """SELECT DISTINCT trade_date, universe_source, 'Coverage universe snapshot for ' || trade_date || ' is ' || universe_source
              || '; formal historical PIT conclusions are not supported.' AS warning FROM coversrc
       WHERE NOT (universe_source LIKE '%historical_pit%' OR universe_source = 'universe_members')""",
    ["coversrc"],
)
def _(t):
    return va.coverage_warnings(covered_by_source(t))


@query(
    "f6_resolve_gate_universe",
    """
    SELECT trade_date, entity, universe_source FROM (
      SELECT *, min(p) OVER (PARTITION BY trade_date) AS best FROM (
        SELECT DISTINCT trade_date, entity, 0 AS p, 'factor_run_universe' AS universe_source FROM snap
          WHERE trade_date < DATE '1997-01-01'
        UNION ALL SELECT DISTINCT trade_date, entity, 1, 'pit_universe_members' FROM mem_on
          WHERE trade_date >= DATE '1998-01-01'
        UNION ALL SELECT d.trade_date, x.entity, 2, 'securities_fallback' FROM securities x JOIN cal d ON x.list_date <= d.trade_date
          WHERE NOT coalesce(x.delist_date <= d.trade_date AND coalesce(x.delist_effective, x.delist_date) <= d.trade_date, FALSE)))
    WHERE p = best
    """,
    ["snap", "mem_on", "securities", "cal"],
)
def _(t):
    from tidemark.operators.factors import listed_universe

    days = open_days(t.calendar)
    members = asof.intervals_on_dates(t.members, days).filter("trade_date >= DATE'1998-01-01'")
    return un.first_available(
        [
            ("factor_run_universe", snapshot(t).filter("trade_date < DATE'1997-01-01'")),
            ("pit_universe_members", members),
            ("securities_fallback", listed_universe(t.securities, days)),
        ]
    )


@query(
    "f7_universe_kind_counts",
    """SELECT coalesce(nullif(trim(universe_kind), ''), 'unknown_legacy') AS universe_kind, count(*) AS row_count
       FROM members GROUP BY 1""",
    ["members"],
)
def _(t):
    return un.kind_counts(t.members)
