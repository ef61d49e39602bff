"""Query registry and the SQL definitions of the shared views.

Each query is registered with the Spark callable and, where SQL can state the
same thing over whole tables, an independent SQL text.  ``CTES`` repeats the
views of :mod:`tidemark.plans.views` in SQL so that both sides start from the
same definitions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.views import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# name -> (names it reads, SQL)
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, reads: Sequence[str] = ()) -> None:
    CTES[name] = (tuple(reads), sql)


def with_views(sql: str, reads: Sequence[str]) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in CTES[name][0]:
            visit(dep)
        ordered.append(name)

    for name in reads:
        visit(name)
    if not ordered:
        return sql
    parts = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in ordered)
    return f"WITH {parts}\n{sql}"


def finish(df: DataFrame) -> DataFrame:
    """Output form shared with the SQL side: rounded doubles, 64-bit integers."""
    out = []
    for field in df.schema.fields:
        kind, column = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind in ("double", "float"):
            # The offset moves natural decimal halves off the rounding border, where
            # the order of a floating sum would decide the last digit.
            column = F.round(column.cast("double") + F.lit(2e-9), 6) + F.lit(0.0)
        elif kind in ("integer", "short", "byte"):
            column = column.cast("long")
        out.append(column.alias(field.name))
    return df.select(*out)


def query(
    name: str,
    sql: str | None = None,
    reads: Sequence[str] = (),
    doubles: str = "",
    longs: str = "",
):
    """Register ``fn(tables) -> DataFrame`` under ``name``.

    ``doubles`` and ``longs`` name SQL output columns to round or to cast so
    that both sides have the same types.
    """

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: finish(fn(Tables(spark, sf_dir)))
        if sql is not None:
            body = sql
            forms = [f"round(CAST({c} AS DOUBLE) + 2e-9, 6) + 0.0 AS {c}" for c in doubles.split()]
            forms += [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()]
            if forms:
                body = f"SELECT * REPLACE ({', '.join(forms)}) FROM ({sql}) _out"
            ORACLES[name] = with_views(body, reads)
        return fn

    return wrap


# ---- shared view definitions ------------------------------------------
cte(
    "panel",
    """
    SELECT entity, trade_date, open, greatest(mx, close) AS high, least(open, close) AS low, close, volume, amount,
           CASE WHEN entity % 9 <> 0 THEN 1 + tax END AS adj_factor, is_suspended,
           close * 1.1 AS limit_up, close * 0.9 AS limit_down,
           CASE WHEN (entity + (trade_date - DATE '1995-01-02') // 7) % 11 = 0 THEN -close / 100 ELSE close / 100 END AS pe_ttm,
           avg_qty / 10 AS pb, amount AS total_mv,
           CASE WHEN entity % 7 = 0 THEN NULL WHEN entity % 13 = 0 THEN 0.0 ELSE amount * 0.8 END AS float_mv
    FROM (SELECT l_suppkey AS entity, CAST(date_trunc('week', l_shipdate) AS DATE) AS trade_date,
                 sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity) AS close,
                 sum(l_quantity) AS volume, sum(l_extendedprice) AS amount,
                 min(l_extendedprice / l_quantity) AS open, max(l_extendedprice / l_quantity) AS mx,
                 avg(l_tax) AS tax, avg(l_quantity) AS avg_qty, bool_and(l_returnflag = 'R') AS is_suspended
          FROM lineitem GROUP BY 1, 2)
    """,
)
cte("cal", "SELECT DISTINCT CAST(date_trunc('week', l_shipdate) AS DATE) AS trade_date, TRUE AS is_open FROM lineitem")
cte(
    "calgap",
    "SELECT trade_date, ((trade_date - DATE '1995-01-02') // 7) % 10 <> 9 AS is_open FROM cal",
    ["cal"],
)
cte(
    "ords",
    "SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS ord FROM cal WHERE is_open",
    ["cal"],
)
cte(
    "securities",
    """
    SELECT s_suppkey AS entity, s_name AS name, DATE '1995-01-02' AS list_date,
           CASE WHEN s_suppkey % 10 = 3 THEN DATE '1999-01-04' + CAST((s_suppkey % 1000) * 7 AS INTEGER) END AS delist_date,
           CASE WHEN s_suppkey % 10 = 3 THEN DATE '1999-01-04' + CAST((s_suppkey % 1000) * 7 AS INTEGER) - 10 END AS delist_publish,
           CASE WHEN s_suppkey % 10 = 3 THEN DATE '1999-01-04' + CAST((s_suppkey % 1000) * 7 AS INTEGER) - 3 END AS delist_effective
    FROM supplier
    """,
)
cte(
    "industries",
    """
    SELECT s_suppkey AS entity, 'std' AS standard, r_name AS industry_l1, n_name AS industry_l2, 'v1' AS version,
           DATE '1995-01-02' AS in_date, DATE '1994-12-26' AS in_publish, DATE '1995-01-02' AS in_effective,
           CASE WHEN s_suppkey % 5 = 0 THEN DATE '1998-01-05' END AS out_date,
           CASE WHEN s_suppkey % 5 = 0 THEN DATE '1997-12-29' END AS out_publish,
           CASE WHEN s_suppkey % 5 = 0 THEN DATE '1998-01-12' END AS out_effective
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    UNION ALL
    SELECT s_suppkey, 'std', r_name, n_name || '_B', 'v2',
           DATE '1998-01-05', DATE '1997-12-29', DATE '1998-01-12', NULL, NULL, NULL
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE s_suppkey % 5 = 0
    """,
)
cte(
    "members",
    """
    SELECT s_suppkey AS entity, 'X' AS index_code, 'main' AS source,
           CASE WHEN s_suppkey % 4 <> 1 THEN 'main' END AS source_tag,
           CASE WHEN s_suppkey % 10 = 6 THEN 'current_snapshot' WHEN s_suppkey % 10 = 5 THEN NULL
                ELSE 'historical_pit' END AS universe_kind,
           DATE '1995-01-02' AS in_date, DATE '1994-12-26' AS in_publish, DATE '1995-01-02' AS in_effective,
           CASE WHEN s_suppkey % 10 = 7 THEN DATE '2000-01-03' END AS out_date,
           CASE WHEN s_suppkey % 10 = 7 THEN DATE '1999-12-20' END AS out_publish,
           CASE WHEN s_suppkey % 10 = 7 THEN DATE '1999-12-27' END AS out_effective
    FROM supplier WHERE s_suppkey % 10 < 8
    """,
)
cte(
    "ststatus",
    """
    SELECT s_suppkey AS entity, 'ST' AS st_type, DATE '1997-01-06' AS in_date, DATE '1997-01-03' AS in_publish,
           DATE '1997-01-07' AS in_effective, DATE '1998-02-09' AS out_date, DATE '1998-02-03' AS out_publish,
           DATE '1998-02-06' AS out_effective
    FROM supplier WHERE s_suppkey % 4 = 0
    """,
)
cte(
    "fundamentals",
    """
    SELECT b.*, (SELECT min(trade_date) FROM cal WHERE is_open AND trade_date > b.publish_time) AS effective_date
    FROM (SELECT entity, report_period,
                 report_period + CAST(entity % 10 + 20 AS INTEGER) + CAST(rev * 30 AS INTEGER) AS publish_time,
                 revenue * CASE WHEN rev = 1 THEN 1.02 ELSE 1.0 END AS revenue,
                 net_profit * CASE WHEN rev = 1 THEN 1.02 ELSE 1.0 END AS net_profit,
                 net_profit * CASE WHEN rev = 1 THEN 1.02 ELSE 1.0 END * 0.9 AS operating_cashflow
          FROM (SELECT l_suppkey AS entity,
                       CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH AS DATE) - 1 AS report_period,
                       CAST(sum(l_extendedprice * (1 - l_discount)) AS DOUBLE) AS revenue,
                       CAST(sum(l_extendedprice * (l_tax - l_discount + 0.015)) AS DOUBLE) AS net_profit
                FROM lineitem GROUP BY 1, 2)
          CROSS JOIN (VALUES (0), (1)) r(rev)
          WHERE rev = 0 OR entity % 3 = 0) b
    """,
    ["cal"],
)
cte(
    "ordent",
    "SELECT l_orderkey, min(l_suppkey) AS first_entity, max(l_suppkey) AS last_entity FROM lineitem GROUP BY 1",
)
cte(
    "nextopen",
    """
    SELECT day, (SELECT min(trade_date) FROM cal WHERE is_open AND trade_date > day) AS next_open,
           (SELECT count(*) FROM cal WHERE is_open AND trade_date <= day) AS upto
    FROM (SELECT CAST(unnest(generate_series(DATE '1990-01-01', DATE '2006-12-31', INTERVAL 1 DAY)) AS DATE) AS day)
    """,
    ["cal"],
)
cte(
    "announcements",
    """
    SELECT o_orderkey AS announcement_id, first_entity AS entity, o_orderpriority AS announcement_type,
           CAST(o_orderdate AS DATE) AS publish_time,
           CASE WHEN o_orderkey % 5 <> 0 THEN 'tag' || CAST(o_orderkey % 2 AS VARCHAR) END AS source_tag,
           'orders' AS source, 'Order notice ' || CAST(o_orderkey AS VARCHAR) AS title, next_open AS effective_date
    FROM orders JOIN ordent ON o_orderkey = l_orderkey LEFT JOIN nextopen ON day = CAST(o_orderdate AS DATE)
    """,
    ["ordent", "nextopen"],
)
cte(
    "riskevents",
    """
    SELECT o_orderkey AS event_id, last_entity AS entity, o_orderstatus AS event_type,
           CAST(o_orderdate AS DATE) AS event_date, CAST(o_orderdate AS DATE) + 2 AS publish_time, 'orders' AS source,
           next_open AS effective_date
    FROM orders JOIN ordent ON o_orderkey = l_orderkey LEFT JOIN nextopen ON day = CAST(o_orderdate AS DATE) + 2
    WHERE o_orderstatus <> 'O'
    """,
    ["ordent", "nextopen"],
)
cte(
    "runs",
    """
    SELECT o_orderkey AS run_id, o_orderpriority AS kind,
           CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'succeeded'
                WHEN o_orderstatus = 'O' THEN 'running' ELSE 'failed' END AS status,
           CAST(o_orderdate AS DATE) AS as_of_date, CAST(o_orderdate AS DATE) AS started_at,
           CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 AS INTEGER) END AS finished_at,
           CASE WHEN o_orderkey % 4 = 0 THEN 'formal' ELSE 'draft' END AS run_mode,
           'run-' || CAST(o_orderkey % 100 AS VARCHAR) AS source_run_id
    FROM orders
    """,
)
cte(
    "artifacts",
    """
    SELECT l_orderkey AS run_id,
           'out/' || l_returnflag || '/' || l_linestatus || '/part-' || CAST(l_linenumber AS VARCHAR) || '.csv' AS path,
           CAST(l_quantity AS BIGINT) AS row_count, CAST(l_shipdate AS DATE) AS created_at
    FROM lineitem
    """,
)
