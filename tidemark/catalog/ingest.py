"""A: scans, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.catalog.factors import PARAMS, factor_rows
from tidemark.catalog.validation import RUN_READS, RUN_SQL as ORACLES_OF_RUN, validation_frames
from tidemark.catalog.registry import cte, query
from tidemark.catalog.scalars import RAW_CODE
from tidemark.functions import columns as col
from tidemark.functions.calendar import month_ends
from tidemark.operators import factors as fx
from tidemark.operators import quality as qa
from tidemark.operators.validation import forward_labels, label_summary
from tidemark.session import shared_dir
from tidemark.sources import prepare as pr
from tidemark.sources import readers as rd
from tidemark.sources import snapshots
from tidemark.sources import writers as wr

START, END, DAY = "1997-01-01", "1998-12-31", "1999-06-07"
_RANGE = f"trade_date BETWEEN DATE '{START}' AND DATE '{END}'"
_SPARK_RANGE = f"trade_date BETWEEN DATE'{START}' AND DATE'{END}'"


def new_path(t, suffix=""):
    return f"{shared_dir(t.spark)}/out-{uuid.uuid4().hex}{suffix}"


PRICE_SCHEMA = (
    "entity BIGINT, trade_date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, amount DOUBLE, "
    "adj_factor DOUBLE, is_suspended BOOLEAN, limit_up DOUBLE, limit_down DOUBLE"
)
_PRICE_COLS = [c.split()[0] for c in PRICE_SCHEMA.split(", ")]
_PRICE_DOUBLES = "open high low close volume amount adj_factor limit_up limit_down"


@query("a1_csv_price_load", f"SELECT {', '.join(_PRICE_COLS)} FROM panel", ["panel"], doubles=_PRICE_DOUBLES)
def _(t):
    path = new_path(t, ".csv")
    t.prices.select(*_PRICE_COLS).write.option("header", True).csv(path)
    loaded = rd.read_csv(t.spark, path, PRICE_SCHEMA)
    return rd.check_columns(loaded, _PRICE_COLS, _PRICE_COLS, "prices CSV")


_MEMBER_SCHEMA = "entity BIGINT, index_code STRING, in_date DATE, in_effective DATE, out_date DATE, out_effective DATE"
_MEMBER_COLS = [c.split()[0] for c in _MEMBER_SCHEMA.split(", ")]


@query(
    "a3_interval_table_load",
    f"SELECT {', '.join(_MEMBER_COLS)}, form FROM members CROSS JOIN (VALUES ('csv'), ('parquet')) f(form)",
    ["members"],
)
def _(t):
    rows = t.members.select(*_MEMBER_COLS)
    csv, parquet = new_path(t, ".csv"), new_path(t, ".parquet")
    rows.write.option("header", True).csv(csv)
    rows.write.parquet(parquet)
    a = rd.read_table(t.spark, csv, _MEMBER_SCHEMA).selectExpr("*", "'csv' AS form")
    return a.unionByName(rd.read_table(t.spark, parquet, _MEMBER_SCHEMA).selectExpr("*", "'parquet' AS form"))


@query(
    "a4_announcement_csv",
    """SELECT CAST(o_orderkey AS VARCHAR) AS announcement_id, CASE WHEN o_orderkey % 5 <> 0 THEN 'Notice, "' || o_orderpriority || '"' END AS title,
              CASE WHEN o_orderkey % 7 NOT IN (0, 1) THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS publish_day,
              CASE WHEN o_orderkey % 7 = 0 THEN 'missing publish_time' WHEN o_orderkey % 7 = 1 THEN 'bad publish_time'
                   WHEN o_orderkey % 5 = 0 THEN 'missing title' END AS row_error FROM orders""",
)
def _(t):
    path = new_path(t, ".csv")
    t.raw("orders").selectExpr(
        "o_orderkey AS `﻿announcement_id`",
        "CASE WHEN o_orderkey % 5 = 0 THEN '  ' ELSE concat('Notice, \"', o_orderpriority, '\"') END AS title",
        "CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN '12/31 noon' ELSE CAST(o_orderdate AS STRING) END AS publish_time",
    ).write.option("header", True).option("escape", '"').csv(path)
    rows = rd.read_announcements(t.spark, path, ["announcement_id", "title", "publish_time"])
    return rows.selectExpr("announcement_id", "title", "CAST(to_date(publish_time) AS STRING) AS publish_day", "row_error")


@query(
    "a5_scan_codes_and_range",
    f"SELECT {', '.join(_PRICE_COLS)} FROM panel WHERE {_RANGE} AND entity IN (SELECT s_suppkey FROM supplier WHERE s_nationkey % 2 = 0)",
    ["panel"],
    doubles=_PRICE_DOUBLES,
)
def _(t):
    codes = t.raw("supplier").filter("s_nationkey % 2 = 0").selectExpr("s_suppkey AS entity")
    return rd.scan_panel(t.prices, codes, START, END)


_CODE = "concat(lpad(CAST(entity % 1000000 AS STRING), 6, '0'), '.SZ')"
_CODE_SQL = "lpad(CAST(entity % 1000000 AS VARCHAR), 6, '0') || '.SZ'"


def vendor_prices(t):
    """The panel as a vendor would name and type it."""
    return t.prices.selectExpr(
        f"{_CODE} AS `股票代码`",
        "CAST(trade_date AS STRING) AS `Trade Date`",
        "CAST(open AS STRING) AS `开盘`",
        "CAST(high AS STRING) AS `HIGH`",
        "CAST(low AS STRING) AS `最低价`",
        "CASE WHEN entity % 2 = 0 THEN CAST(close AS STRING) END AS `收盘`",
        "CAST(close * 2 AS STRING) AS `收盘价`",
        "CASE WHEN entity % 17 = 0 THEN 'n/a' ELSE CAST(volume AS STRING) END AS `成交量`",
        "CAST(amount AS STRING) AS `amount`",
        "CASE WHEN is_suspended THEN '是' ELSE 'No' END AS `停牌`",
        "'x' AS `vendor remark`",
    )


@query(
    "a6_renamed_columns",
    f"""SELECT {_CODE_SQL} AS stock_code, CAST(trade_date AS VARCHAR) AS trade_date, CASE WHEN is_suspended THEN '是' ELSE 'No' END AS is_suspended FROM panel""",
    ["panel"],
)
def _(t):
    return rd.rename_columns(vendor_prices(t), "daily_prices").select("stock_code", "trade_date", "is_suspended")


@query(
    "a7_coalesced_aliases",
    f"SELECT {_CODE_SQL} AS stock_code, trade_date, CASE WHEN entity % 2 = 0 THEN close ELSE close * 2 END AS close FROM panel",
    ["panel"],
    doubles="close",
)
def _(t):
    return rd.rename_columns(vendor_prices(t), "daily_prices").selectExpr(
        "stock_code", "CAST(trade_date AS DATE) AS trade_date", "CAST(close AS DOUBLE) AS close"
    )


@query(
    "a8_normalized_prices",
    f"""SELECT {_CODE_SQL} AS stock_code, trade_date, open, high, low, CASE WHEN entity % 2 = 0 THEN close ELSE close * 2 END AS close,
               CASE WHEN entity % 17 <> 0 THEN CAST(volume AS BIGINT) END AS volume, amount, CAST(NULL AS DOUBLE) AS adj_factor, is_suspended,
               CAST(NULL AS DOUBLE) AS limit_up, CAST(NULL AS DOUBLE) AS limit_down, CAST(NULL AS VARCHAR) AS source FROM panel""",
    ["panel"],
    doubles="open high low close amount",
)
def _(t):
    return rd.normalize_dataset(vendor_prices(t), "daily_prices")[0]


@query(
    "a8_conversion_errors",
    "SELECT 'volume' AS field, count(*) AS bad_values FROM panel WHERE entity % 17 = 0",
    ["panel"],
)
def _(t):
    return rd.normalize_dataset(vendor_prices(t), "daily_prices")[1]


@query(
    "a9_range_replace",
    f"""SELECT entity, trade_date, close FROM panel WHERE NOT ({_RANGE})
        UNION ALL SELECT entity, trade_date, close * 2 FROM panel WHERE {_RANGE} AND entity % 2 = 0""",
    ["panel"],
    doubles="close",
)
def _(t):
    rows = t.prices.select("entity", "trade_date", "close")
    fresh = rows.filter(f"{_SPARK_RANGE} AND entity % 2 = 0").selectExpr("entity", "trade_date", "close * 2 AS close")
    path = new_path(t)
    wr.replace_range_at(t.spark, path, rows, _SPARK_RANGE)  # a new table
    wr.replace_range_at(t.spark, path, fresh, _SPARK_RANGE)
    return snapshots.read(t.spark, path, rows.schema)


_RUN = "'run_a' AS source_run_id"


def _store(t):
    return factor_rows(t, ["return_60d"]).selectExpr("*", _RUN)


@query(
    "a10_append_conflicts",
    """SELECT 'run_a' AS source_run_id, entity, trade_date, as_of_date, factor_name, 'already_stored' AS conflict FROM f_return_60d WHERE entity % 10 = 1
       UNION ALL SELECT 'run_a', entity, trade_date, as_of_date, factor_name, 'duplicate_in_input' FROM f_return_60d WHERE entity % 10 = 2""",
    ["f_return_60d"],
)
def _(t):
    store = _store(t)
    # Stored: all but remainder 2.  Incoming: remainder 1 (stored already) and 2 (twice), with NULLs to be dropped.
    copies = "explode(CASE WHEN entity % 10 = 2 THEN array(1, 2) ELSE array(1) END) AS c"
    incoming = store.filter("entity % 10 IN (1, 2, 3)").selectExpr("*", copies).drop("c")
    incoming = incoming.withColumn("factor_value", F.expr("CASE WHEN entity % 10 = 3 THEN NULL ELSE factor_value END"))
    return wr.append_conflicts(store.filter("entity % 10 <> 2"), incoming)


@query(
    "a10_appended_store",
    """SELECT entity, trade_date, factor_name, factor_value, as_of_date, 'run_b' AS source_run_id FROM f_return_60d
         WHERE entity % 10 NOT IN (3, 5) AND factor_value IS NOT NULL
       UNION ALL SELECT entity, trade_date, factor_name, factor_value, as_of_date, 'run_a' FROM f_return_60d
         WHERE entity % 10 = 4 AND factor_value IS NOT NULL""",
    ["f_return_60d"],
    doubles="factor_value",
)
def _(t):
    store = _store(t)
    path = new_path(t)
    wr.append_factor_rows(None, store.filter("entity % 10 = 4"), path)
    incoming = store.selectExpr(
        "entity", "trade_date", "factor_name",
        "CASE WHEN entity % 10 = 3 THEN double('NaN') WHEN entity % 10 = 5 THEN NULL ELSE factor_value END AS factor_value",
        "as_of_date", "'run_b' AS source_run_id",
    )
    wr.append_factor_rows(None, incoming, path)
    return snapshots.read(t.spark, path, incoming.schema)


@query(
    "a11_scoped_replace",
    f"""SELECT entity, trade_date, factor_name, factor_value, as_of_date, 'run_a' AS source_run_id FROM f_return_60d WHERE NOT ({_RANGE})
        UNION ALL SELECT entity, trade_date, factor_name, factor_value + 1, as_of_date, 'run_a' FROM f_return_60d WHERE {_RANGE} AND entity % 2 = 0""",
    ["f_return_60d"],
    doubles="factor_value",
)
def _(t):
    store = _store(t)
    fresh = store.filter(f"{_SPARK_RANGE} AND entity % 2 = 0").withColumn("factor_value", F.expr("factor_value + 1"))
    path = new_path(t)
    wr.append_factor_rows(None, store, path)
    wr.replace_factor_scope_at(fresh, path)
    return snapshots.read(t.spark, path, store.schema)


_CUTS = ("1997-06-30", "1998-06-29", "1998-07-06")


@query(
    "a10_daily_appends",
    f"SELECT *, 'run_d' AS source_run_id FROM fv WHERE factor_name IN ('return_60d', 'pe_ttm_percentile', 'is_st') AND trade_date BETWEEN DATE '{_CUTS[0]}' AND DATE '{_CUTS[2]}'",
    ["fv"],
    doubles="factor_value",
)
def _(t):
    """A store that is extended by range runs, a year and then a week, each appended to the version before."""
    path, names = new_path(t), ["return_60d", "pe_ttm_percentile", "is_st"]
    spans = [(_CUTS[0], _CUTS[1]), ("1998-06-30", _CUTS[2])]
    for start, end in spans:
        rows = fx.range_factors(t, t.history, start, end, names, params=PARAMS).selectExpr("*", "'run_d' AS source_run_id")
        wr.append_factor_rows(None, rows, path)
    return snapshots.read(t.spark, path, rows.schema)


@query(
    "a12_readback_counts",
    f"""SELECT 'daily_prices' AS dataset, count(*) AS expected_rows, count(*) AS stored_rows, TRUE AS matches FROM panel WHERE {_RANGE}
        UNION ALL SELECT 'universe_members', count(*), count(*) FILTER (WHERE source_tag = 'main'), count(*) = count(*) FILTER (WHERE source_tag = 'main') FROM members""",
    ["panel", "members"],
)
def _(t):
    prices = t.prices.filter(_SPARK_RANGE)
    paths = {"daily_prices": new_path(t), "universe_members": new_path(t)}
    wr.swap_in(prices, paths["daily_prices"])
    wr.swap_in(t.members.filter("source_tag = 'main'"), paths["universe_members"])
    return wr.readback(
        {"daily_prices": snapshots.read(t.spark, paths["daily_prices"], prices.schema),
         "universe_members": snapshots.read(t.spark, paths["universe_members"], t.members.schema)},
        {"daily_prices": prices, "universe_members": t.members},
    )


@query(
    "a13_report_sink",
    "SELECT max(trade_date) AS signal_date, CAST(date_trunc('month', trade_date) AS DATE) AS month FROM cal GROUP BY 2",
    ["cal"],
)
def _(t):
    path = new_path(t)
    wr.write_report(month_ends(t.calendar), ["month", "signal_date"], ["month"], path)
    return t.spark.read.schema("month DATE, signal_date DATE").parquet(path)


@query(
    "a14_reloaded_validation_output",
    """SELECT horizon, count(*) AS valid_label_count, max(trade_date) AS latest_usable_signal_date FROM labels_fwd WHERE horizon = 5 GROUP BY 1""",
    ["labels_fwd"],
    longs="horizon",
)
def _(t):
    path = new_path(t)
    summary = label_summary(forward_labels(t.prices, t.calendar, [5]), [5])
    wr.write_report(summary, summary.columns, ["horizon"], path, form="csv")
    loaded = rd.read_csv(t.spark, path, "horizon BIGINT, valid_label_count BIGINT, latest_usable_signal_date DATE")
    return rd.check_columns(loaded, ["horizon", "valid_label_count"], what="label summary")


@query(
    "a14_reloaded_validation_outputs",
    ORACLES_OF_RUN,
    RUN_READS,
)
def _(t):
    """All outputs of a validation run, written as CSV reports and read back."""
    out = None
    for name, df in validation_frames(t).items():
        path = new_path(t, ".csv")
        wr.write_report(df, df.columns, df.columns[:2], path, form="csv")
        loaded = rd.read_csv(t.spark, path, ", ".join(f"{c} {k}" for c, k in df.dtypes))
        part = loaded.agg(F.expr(f"'{name}' AS frame"), F.expr("count(*) AS n"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "a15_assembled_valuation",
    f"""SELECT entity, trade_date, pe_ttm + 1 AS pe_ttm, pb, CASE WHEN entity % 4 <> 0 THEN total_mv END AS total_mv
        FROM panel WHERE entity % 3 <> 0 AND {_RANGE}""",
    ["panel"],
    doubles="pe_ttm pb total_mv",
)
def _(t):
    series = (
        "array(named_struct('indicator', 'pe_ttm', 'value', pe_ttm, 'seq', 1), named_struct('indicator', 'pe_ttm', 'value', pe_ttm + 1, 'seq', 2), "
        "CASE WHEN entity % 3 <> 0 THEN named_struct('indicator', 'pb', 'value', pb, 'seq', 1) END, "
        "CASE WHEN entity % 4 <> 0 THEN named_struct('indicator', 'total_mv', 'value', total_mv, 'seq', 1) END)"
    )
    long = t.valuations.selectExpr("entity", "trade_date", f"inline(array_compact({series}))")
    return pr.assemble_valuation(long, START, END)


@query(
    "a16_bar_units",
    "SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS trade_date, l_extendedprice AS close, l_quantity * 100 AS volume, l_quantity * 100 * l_extendedprice AS amount FROM lineitem",
    doubles="close volume amount",
)
def _(t):
    bars = t.raw("lineitem").selectExpr(
        "l_suppkey AS entity", "to_date(l_shipdate) AS trade_date", "l_extendedprice AS close", "l_quantity AS lots"
    )
    return pr.fix_bar_units(bars)


@query(
    "a17_filled_trade_date",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) ELSE CAST(o_orderdate AS DATE) + 1 END AS trade_date FROM orders""",
)
def _(t):
    rows = t.raw("orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 2 = 0 THEN CAST(to_date(o_orderdate) AS STRING) ELSE ' ' END AS a",
        "CASE WHEN o_orderkey % 3 = 0 THEN CAST(to_date(o_orderdate) AS STRING) END AS b",
        "CAST(date_add(to_date(o_orderdate), 1) AS STRING) AS c",
    )
    return pr.fill_trade_date(rows, ["a", "b", "c"]).select("o_orderkey", "trade_date")


def _codes(t):
    return t.raw("customer").selectExpr("lpad(CAST(c_custkey AS STRING), 9, '0') AS code")


def _requested(t):
    """Codes asked for by name: some customers, and part numbers beyond them that do not exist."""
    present = t.raw("customer").filter("c_custkey % 211 = 5").selectExpr("lpad(CAST(c_custkey AS STRING), 9, '0') AS code")
    absent = t.raw("supplier").filter("s_suppkey % 4 = 0").selectExpr("concat('S', s_suppkey) AS code")
    return present.unionByName(absent)


_REQ = """(SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS code FROM customer WHERE c_custkey % 211 = 5
           UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 4 = 0)"""


@query(
    "a18_capped_universe",
    f"""SELECT c.code, r.code IS NOT NULL AS requested FROM (SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS code FROM customer) c
        LEFT JOIN {_REQ} r ON r.code = c.code ORDER BY (r.code IS NOT NULL) DESC, c.code LIMIT 20""",
)
def _(t):
    return pr.cap_universe(_codes(t), _requested(t), 20)


@query(
    "a18_missing_requested",
    "SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS code FROM supplier WHERE s_suppkey % 4 = 0",
)
def _(t):
    return pr.missing_requested(_codes(t), _requested(t))


def _security_inputs(t):
    base = t.raw("orders").selectExpr("o_orderkey", f"{col.stock_code(f'({RAW_CODE})')} AS code", "o_orderpriority", "to_date(o_orderdate) AS d")
    codes = base.filter("code IS NOT NULL").select("code").distinct()
    listed = base.filter("code IS NOT NULL AND o_orderkey % 3 <> 0").groupBy("code").agg(
        F.expr("min(o_orderkey) AS k"), F.expr("min(d) AS list_date")
    ).selectExpr("code", "CASE WHEN k % 2 = 0 THEN concat('name', k) ELSE ' ' END AS stock_name", "CAST(NULL AS STRING) AS exchange",
                 "CASE WHEN k % 5 <> 0 THEN list_date END AS list_date")
    names = base.filter("code IS NOT NULL AND o_orderkey % 2 = 1").selectExpr("code", "o_orderpriority AS stock_name")
    return codes, listed, names


@query(
    "a19_completed_securities",
    f"""SELECT c.code, coalesce(CASE WHEN l.k % 2 = 0 THEN 'name' || CAST(l.k AS VARCHAR) END, n.nm) AS stock_name,
               CASE right(c.code, 3) WHEN '.SH' THEN 'SHSE' WHEN '.SZ' THEN 'SZSE' ELSE 'BSE' END AS exchange,
               coalesce(CASE WHEN l.k % 5 <> 0 THEN l.d END, DATE '{DAY}') AS list_date, l.k IS NULL OR l.k % 5 = 0 AS synthetic_list_date
        FROM (SELECT DISTINCT code FROM ncodes WHERE code IS NOT NULL) c
        LEFT JOIN (SELECT code, min(n.o_orderkey) AS k, min(CAST(o.o_orderdate AS DATE)) AS d FROM ncodes n JOIN orders o ON o.o_orderkey = n.o_orderkey
                   WHERE n.o_orderkey % 3 <> 0 GROUP BY 1) l ON l.code = c.code
        LEFT JOIN (SELECT code, min(o_orderpriority) AS nm FROM ncodes n JOIN orders o ON o.o_orderkey = n.o_orderkey WHERE n.o_orderkey % 2 = 1 GROUP BY 1) n
          ON n.code = c.code""",
    ["ncodes"],
)
def _(t):
    return pr.complete_securities(*_security_inputs(t), DAY)


@query(
    "a20_completed_members",
    f"""SELECT 'X' AS index_code, s_suppkey AS code, CASE WHEN s_suppkey % 2 = 0 THEN DATE '1996-03-04' ELSE DATE '{DAY}' END AS in_date, pub AS in_publish,
               coalesce(g.next_open, CASE WHEN s_suppkey % 2 = 0 THEN DATE '1996-03-04' ELSE DATE '{DAY}' END) AS in_effective,
               CAST(NULL AS DATE) AS out_date, CAST(NULL AS DATE) AS out_publish, CAST(NULL AS DATE) AS out_effective,
               'feed' AS source, 'feed' AS source_tag, 'historical_pit' AS universe_kind
        FROM (SELECT *, CASE WHEN s_suppkey % 3 = 0 THEN DATE '1996-03-05' END AS pub FROM supplier) s LEFT JOIN gapnext g ON g.day = s.pub""",
    ["gapnext"],
)
def _(t):
    none = "CAST(NULL AS DATE)"
    raw = t.raw("supplier").selectExpr(
        "CAST(NULL AS STRING) AS index_code", "s_suppkey AS code", "CASE WHEN s_suppkey % 2 = 0 THEN DATE'1996-03-04' END AS in_date",
        "CASE WHEN s_suppkey % 3 = 0 THEN DATE'1996-03-05' END AS in_publish", f"{none} AS in_effective", f"{none} AS out_date",
        f"{none} AS out_publish", f"{none} AS out_effective",
    )
    return pr.complete_members(raw, t.calendar_gaps, "X", "feed", DAY)


@query(
    "a21_legacy_defaults",
    """SELECT entity, source, coalesce(source_tag, source, 'legacy') AS source_tag, coalesce(universe_kind, 'unknown_legacy') AS universe_kind FROM members""",
    ["members"],
)
def _(t):
    return pr.legacy_defaults(t.members.select("entity", "source", "source_tag", "universe_kind"))


@query(
    "a22_resolved_source",
    "SELECT DISTINCT source FROM announcements WHERE source <> 'legacy'",
    ["announcements"],
)
def _(t):
    old = t.prices.selectExpr("CASE WHEN entity % 2 = 0 THEN 'legacy' ELSE ' ' END AS source")
    return pr.resolve_source([t.announcements, t.risk_events, old])


_INTERVAL = "entity, index_code, source_tag, in_date, in_effective, out_date, out_effective"


@query(
    "a23_imported_members",
    """SELECT entity, index_code, 'main' AS source_tag, in_date, in_effective, out_date, out_effective FROM members WHERE entity % 2 = 0
       UNION ALL SELECT entity, index_code, source_tag, in_date, in_effective, out_date, out_effective FROM members WHERE source_tag IS NULL""",
    ["members"],
)
def _(t):
    cols = _INTERVAL.split(", ")
    incoming = t.members.filter("entity % 2 = 0").withColumn("source_tag", F.lit("main")).select(*cols)
    return pr.import_members(t.members.select(*cols), incoming, overwrite=True)


@query(
    "a23_rejected_members",
    """SELECT 'main' AS source_tag, index_code, entity, in_effective, 'open_ended_overlap' AS issue FROM members WHERE entity % 6 = 0
       AND out_effective IS NULL AND source_tag = 'main'""",
    ["members"],
)
def _(t):
    """An import whose intervals overlap: every finding is a row, and importing the set fails."""
    cols = _INTERVAL.split(", ")
    rows = t.members.filter("source_tag = 'main' AND out_effective IS NULL").select(*cols)
    late = rows.filter("entity % 6 = 0").withColumn("in_date", F.expr("date_add(in_date, 70)")).withColumn(
        "in_effective", F.expr("date_add(in_effective, 70)")
    )
    return pr.import_findings(rows.unionByName(late)).select("source_tag", "index_code", "entity", F.expr("date_sub(in_effective, 70) AS in_effective"), "issue")
