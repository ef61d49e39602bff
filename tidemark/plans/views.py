"""Panel views derived from the star-schema tables.

Views are lazy plans over whole tables, except those that most queries share: the weekly panel, its calendar and the
facts summed up from the largest table are stored once per run and data folder (see :func:`tidemark.session.stored`), the panel
bucketed by entity.  Expressions are SQL text: one round trip to the JVM per select, however many columns it has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import next_open
from tidemark.operators.factors import HISTORY_KINDS
from tidemark.schemas import INPUT_SCHEMAS
from tidemark.session import files_state, stored
from tidemark.sources.history import History, stored_history

INDEX_CODE = "X"
WEEK = "date_sub(to_date({0}), weekday(to_date({0})))"
WEEK_NUMBER = "datediff(trade_date, DATE'1995-01-02') div 7"

# The panel's columns from those of its store.
PANEL_COLUMNS = [
    "entity",
    "trade_date",
    "open",
    "greatest(top, close) AS high",
    "least(open, close) AS low",
    "close",
    "volume",
    "amount",
    "CASE WHEN entity % 9 <> 0 THEN 1 + tax END AS adj_factor",
    "is_suspended",
    "close * 1.1D AS limit_up",
    "close * 0.9D AS limit_down",
    f"CASE WHEN (entity + {WEEK_NUMBER}) % 11 = 0 THEN -close / 100 ELSE close / 100 END AS pe_ttm",
    "avg_qty / 10 AS pb",
    "amount AS total_mv",
    "CASE WHEN entity % 7 = 0 THEN NULL WHEN entity % 13 = 0 THEN 0.0D ELSE amount * 0.8D END AS float_mv",
]


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(INPUT_SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def state(self) -> str:
        """State of the input files: tables derived from other files are not used again."""
        return files_state(self.spark, [f"{self.sf_dir}/{name}.parquet" for name in INPUT_SCHEMAS])

    def stored(self, name: str, build: Callable[[], DataFrame], bucket_by: str | None = None, partition_by: Sequence[str] = (), plain: bool = False) -> DataFrame:
        """A table shared by all queries of this run over these files."""
        return stored(self.spark, f"{self.sf_dir}|{self.state}|{name}", build, bucket_by, partition_by, plain)

    # ---- weekly panel -------------------------------------------------
    @cached_property
    def weekly(self) -> DataFrame:
        """Sums of one entity and week, aggregated once."""
        return self.stored("panel", self._panel, "entity")

    @cached_property
    def panel(self) -> DataFrame:
        """Prices and valuations of one entity and week; columns that follow from others are not stored."""
        return self.weekly.selectExpr(*PANEL_COLUMNS)

    def _panel(self) -> DataFrame:
        # Few line items share entity and week, so they go to the buckets as they are: one shuffle for the sums and the bucketed table.
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        lines = self.raw("lineitem").selectExpr(
            "l_suppkey AS entity", f"{WEEK.format('l_shipdate')} AS trade_date", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag = 'R' AS returned",
        )
        return lines.repartition(buckets, "entity").groupBy("entity", "trade_date").agg(
            F.expr("sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity) AS close"),
            F.expr("sum(l_quantity) AS volume"),
            F.expr("sum(l_extendedprice) AS amount"),
            F.expr("min(l_extendedprice / l_quantity) AS open"),
            F.expr("max(l_extendedprice / l_quantity) AS top"),
            F.expr("avg(l_tax) AS tax"),
            F.expr("avg(l_quantity) AS avg_qty"),
            F.expr("bool_and(returned) AS is_suspended"),
        )

    @cached_property
    def history(self) -> History:
        """The panel once more, by month, for runs over a range of dates."""
        return stored_history(self.weekly, HISTORY_KINDS, self.stored, PANEL_COLUMNS)

    @cached_property
    def prices(self) -> DataFrame:
        return self.panel.drop("pe_ttm", "pb", "total_mv", "float_mv")

    @cached_property
    def valuations(self) -> DataFrame:
        return self.panel.selectExpr("entity", "trade_date", "pe_ttm", "pb", "total_mv", "float_mv")

    @cached_property
    def calendar(self) -> DataFrame:
        """All weeks with shipments; every one is open."""
        return self.stored(
            "calendar", lambda: self.panel.select("trade_date").distinct().selectExpr("trade_date", "true AS is_open")
        )

    @cached_property
    def calendar_gaps(self) -> DataFrame:
        """The same weeks with each tenth one closed."""
        return self.calendar.selectExpr("trade_date", f"({WEEK_NUMBER}) % 10 <> 9 AS is_open")

    # ---- reference data -----------------------------------------------
    @cached_property
    def securities(self) -> DataFrame:
        delist = "CASE WHEN s_suppkey % 10 = 3 THEN date_add(DATE'1999-01-04', CAST(s_suppkey % 1000 * 7 AS INT)) END"
        return self.raw("supplier").selectExpr(
            "s_suppkey AS entity",
            "s_name AS name",
            "DATE'1995-01-02' AS list_date",
            f"{delist} AS delist_date",
            f"date_sub({delist}, 10) AS delist_publish",
            f"date_sub({delist}, 3) AS delist_effective",
        )

    @cached_property
    def industries(self) -> DataFrame:
        """One interval per entity, or two where the entity moves in January 1998."""
        joined = (
            self.raw("supplier")
            .join(self.raw("nation"), F.expr("s_nationkey = n_nationkey"))
            .join(self.raw("region"), F.expr("n_regionkey = r_regionkey"))
        )
        steps = "CASE WHEN s_suppkey % 5 = 0 THEN array(1, 2) ELSE array(0) END"
        return joined.selectExpr("*", f"explode({steps}) AS step").selectExpr(
            "s_suppkey AS entity",
            "'std' AS standard",
            "r_name AS industry_l1",
            "CASE WHEN step = 2 THEN concat(n_name, '_B') ELSE n_name END AS industry_l2",
            "CASE WHEN step = 2 THEN 'v2' ELSE 'v1' END AS version",
            "CASE WHEN step = 2 THEN DATE'1998-01-05' ELSE DATE'1995-01-02' END AS in_date",
            "CASE WHEN step = 2 THEN DATE'1997-12-29' ELSE DATE'1994-12-26' END AS in_publish",
            "CASE WHEN step = 2 THEN DATE'1998-01-12' ELSE DATE'1995-01-02' END AS in_effective",
            "CASE WHEN step = 1 THEN DATE'1998-01-05' END AS out_date",
            "CASE WHEN step = 1 THEN DATE'1997-12-29' END AS out_publish",
            "CASE WHEN step = 1 THEN DATE'1998-01-12' END AS out_effective",
        )

    @cached_property
    def members(self) -> DataFrame:
        return self.raw("supplier").filter("s_suppkey % 10 < 8").selectExpr(
            "s_suppkey AS entity",
            f"'{INDEX_CODE}' AS index_code",
            "'main' AS source",
            "CASE WHEN s_suppkey % 4 <> 1 THEN 'main' END AS source_tag",
            "CASE WHEN s_suppkey % 10 = 6 THEN 'current_snapshot' WHEN s_suppkey % 10 = 5 THEN NULL "
            "ELSE 'historical_pit' END AS universe_kind",
            "DATE'1995-01-02' AS in_date",
            "DATE'1994-12-26' AS in_publish",
            "DATE'1995-01-02' AS in_effective",
            "CASE WHEN s_suppkey % 10 = 7 THEN DATE'2000-01-03' END AS out_date",
            "CASE WHEN s_suppkey % 10 = 7 THEN DATE'1999-12-20' END AS out_publish",
            "CASE WHEN s_suppkey % 10 = 7 THEN DATE'1999-12-27' END AS out_effective",
        )

    @cached_property
    def st_status(self) -> DataFrame:
        return self.raw("supplier").filter("s_suppkey % 4 = 0").selectExpr(
            "s_suppkey AS entity",
            "'ST' AS st_type",
            "DATE'1997-01-06' AS in_date",
            "DATE'1997-01-03' AS in_publish",
            "DATE'1997-01-07' AS in_effective",
            "DATE'1998-02-09' AS out_date",
            "DATE'1998-02-03' AS out_publish",
            "DATE'1998-02-06' AS out_effective",
        )

    # ---- published facts ----------------------------------------------
    @cached_property
    def fundamentals(self) -> DataFrame:
        """Quarterly facts with a later revision for every third entity."""
        return self.stored("fundamentals", self._fundamentals)

    def _fundamentals(self) -> DataFrame:
        ship = "to_date(l_shipdate)"
        quarterly = (
            self.raw("lineitem")
            .groupBy(
                F.expr("l_suppkey AS entity"),
                F.expr(f"date_sub(add_months(trunc({ship}, 'quarter'), 3), 1) AS report_period"),
            )
            .agg(
                F.expr("sum(l_extendedprice * (1 - l_discount)) AS revenue"),
                F.expr("sum(l_extendedprice * (l_tax - l_discount + 0.015D)) AS net_profit"),
            )
        )
        scale = "CASE WHEN rev = 1 THEN 1.02D ELSE 1.0D END"
        rows = quarterly.selectExpr(
            "*", "explode(CASE WHEN entity % 3 = 0 THEN array(0, 1) ELSE array(0) END) AS rev"
        ).selectExpr(
            "entity",
            "report_period",
            "date_add(report_period, CAST(entity % 10 + 20 + rev * 30 AS INT)) AS publish_time",
            f"revenue * {scale} AS revenue",
            f"net_profit * {scale} AS net_profit",
            f"net_profit * {scale} * 0.9D AS operating_cashflow",
        )
        return next_open(rows, "publish_time", self.calendar, "effective_date")

    @cached_property
    def orders_with_entities(self) -> DataFrame:
        return self.stored("orders_with_entities", self._orders_with_entities)

    def _orders_with_entities(self) -> DataFrame:
        entities = self.raw("lineitem").groupBy("l_orderkey").agg(
            F.expr("min(l_suppkey) AS first_entity"), F.expr("max(l_suppkey) AS last_entity")
        )
        # Files are many times smaller than their rows: by file size a table of a million orders would be broadcast.
        return self.raw("orders").hint("merge").join(entities, F.expr("o_orderkey = l_orderkey"))

    @cached_property
    def announcements(self) -> DataFrame:
        rows = self.orders_with_entities.selectExpr(
            "o_orderkey AS announcement_id",
            "first_entity AS entity",
            "o_orderpriority AS announcement_type",
            "to_date(o_orderdate) AS publish_time",
            "CASE WHEN o_orderkey % 5 <> 0 THEN concat('tag', o_orderkey % 2) END AS source_tag",
            "'orders' AS source",
            "concat('Order notice ', o_orderkey) AS title",
        )
        return next_open(rows, "publish_time", self.calendar, "effective_date")

    @cached_property
    def risk_events(self) -> DataFrame:
        rows = self.orders_with_entities.filter("o_orderstatus <> 'O'").selectExpr(
            "o_orderkey AS event_id",
            "last_entity AS entity",
            "o_orderstatus AS event_type",
            "to_date(o_orderdate) AS event_date",
            "date_add(to_date(o_orderdate), 2) AS publish_time",
            "'orders' AS source",
        )
        return next_open(rows, "publish_time", self.calendar, "effective_date")

    @cached_property
    def runs(self) -> DataFrame:
        """A run log: one run per order, one artifact per line item."""
        return self.raw("orders").selectExpr(
            "o_orderkey AS run_id",
            "o_orderpriority AS kind",
            "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'succeeded' "
            "WHEN o_orderstatus = 'O' THEN 'running' ELSE 'failed' END AS status",
            "to_date(o_orderdate) AS as_of_date",
            "to_date(o_orderdate) AS started_at",
            "CASE WHEN o_orderstatus <> 'O' THEN date_add(to_date(o_orderdate), CAST(o_orderkey % 3 AS INT)) END "
            "AS finished_at",
            "to_json(named_struct('run_mode', CASE WHEN o_orderkey % 4 = 0 THEN 'formal' ELSE 'draft' END, "
            "'source_run_id', concat(' run-', o_orderkey % 100, ' '))) AS params",
        )

    @cached_property
    def artifacts(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey AS run_id",
            "concat('out/', l_returnflag, '/', l_linestatus, '/part-', l_linenumber, '.csv') AS path",
            "CAST(l_quantity AS BIGINT) AS row_count",
            "to_date(l_shipdate) AS created_at",
        )

    @cached_property
    def parsed_results(self) -> DataFrame:
        """One extraction result per announcement."""
        tag = (
            "CASE WHEN announcement_id % 7 = 0 THEN NULL WHEN announcement_id % 13 = 0 THEN 'other' ELSE source_tag END"
        )
        items = "CASE WHEN announcement_id % {0} = 0 THEN array('item') ELSE CAST(array() AS ARRAY<STRING>) END"
        return self.announcements.selectExpr(
            "sha1(concat_ws('|', 'run', coalesce(source_tag, ''), announcement_id)) AS parse_id",
            "announcement_id",
            "entity",
            "source",
            f"{tag} AS source_tag",
            "CASE WHEN announcement_id % 9 = 0 THEN 'schema_invalid' ELSE 'success' END AS status",
            "element_at(array('positive', 'negative', 'neutral', 'mixed'), CAST(announcement_id % 4 AS INT) + 1) "
            "AS sentiment",
            "0.5D + (announcement_id % 50) / 100 AS confidence",
            "concat('Summary ', announcement_id) AS summary",
            "date_add(publish_time, CAST(announcement_id % 5 AS INT)) AS created_at",
            f"CASE WHEN announcement_id % 17 = 0 THEN '{{bad' ELSE to_json(named_struct('risks', {items.format(3)}, "
            f"'catalysts', {items.format(8)})) END AS parsed_json",
        )
