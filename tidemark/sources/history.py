"""Panel history by month, and the part of it that the windows of a date range reach.

A factor of one day looks a fixed number of *rows* back, and an entity with gaps needs more *days* for them than others.  The store therefore
keeps, beside rows partitioned by month, how many rows each entity has in each month.  A range reads the months that hold enough open days
for everybody, and older months only for the entities whose counts say that they need them.  The counts are a few per cent
of the rows, and exact: no entity gets fewer rows than its windows would see in the whole history.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import open_days
from tidemark.session import materialize

MONTH = "CAST(year({0}) * 12 + month({0}) - 1 AS INT)"


def month_number(day: date | str) -> int:
    day = date.fromisoformat(str(day)[:10])
    return day.year * 12 + day.month - 1


def by_month(panel: DataFrame) -> DataFrame:
    """Rows with their month, ranged by month and entity: a file holds one month and, where a month has many files, few entities."""
    return panel.withColumn("month", F.expr(MONTH.format("trade_date"))).repartitionByRange("month", "entity")


def month_counts(rows: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """``entity, month`` and per kind the number of rows that its windows count."""
    return rows.groupBy("entity", "month").agg(*[F.expr(f"count_if({rule})").alias(kind) for kind, rule in kinds.items()])


@dataclass(frozen=True)
class History:
    """``rows`` of a panel, partitioned by ``month``, and their ``counts`` by entity and month (several rows of a month add up)."""

    rows: DataFrame
    counts: DataFrame

    @staticmethod
    def append(panel: DataFrame, kinds: Mapping[str, str], path: str) -> None:
        """Add rows to the history at ``path``; only their months are written to, nothing is read back.  Counts go last: rows of a failed
        append are seen as more history than counted, which is harmless, but the append must then not be repeated without removing them."""
        added = materialize(by_month(panel), "month")
        added.write.mode("append").partitionBy("month").parquet(f"{path}/rows")
        month_counts(added, kinds).write.mode("append").parquet(f"{path}/counts")

    @staticmethod
    def open(spark: SparkSession, path: str, schema: str, kinds: Mapping[str, str]) -> History:
        """The history at ``path``, whose panel has the columns of ``schema``."""
        counted = ", ".join(["entity BIGINT, month INT", *[f"{kind} BIGINT" for kind in kinds]])
        return History(spark.read.schema(f"{schema}, month INT").parquet(f"{path}/rows"), spark.read.schema(counted).parquet(f"{path}/counts"))

    def first_month(self, calendar: DataFrame, start: date | str, n: int) -> int:
        """Month from which ``n`` open days lie before the month of ``start``; counted by whole months, as the counts are."""
        if n == 0:
            return month_number(start)
        before = open_days(calendar).filter(F.expr(f"trade_date < trunc(DATE'{start}', 'month')"))
        # At most n dates reach the driver as one value.
        first = before.orderBy(F.desc("trade_date")).limit(n).agg(F.min("trade_date")).first()[0]
        return month_number(first or start)

    def older(self, kind: str, first: int, start: date | str, end: date | str, n: int) -> DataFrame:
        """``entity, month`` before ``first`` that entities of the range need for ``n`` rows of the kind before the month of ``start``."""
        own, last = month_number(start), month_number(end)
        counts = self.counts.filter(f"month <= {last}").groupBy("entity", "month").agg(F.sum(kind).alias("n"), F.lit(True).alias("any"))
        short = counts.groupBy("entity").agg(
            F.expr(f"sum(CASE WHEN month >= {first} AND month < {own} THEN n ELSE 0 END)").alias("have"),
            F.expr(f"bool_or(month >= {own})").alias("current"),
        ).filter(f"current AND have < {n}")
        newer = "coalesce(sum(n) OVER (PARTITION BY entity ORDER BY month DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        return (
            counts.filter(f"month < {first} AND n > 0").join(short.select("entity", "have"), "entity")
            .selectExpr("entity", "month", f"have + {newer} AS newer").filter(f"newer < {n}").select("entity", "month")
        )

    def reach(self, kind: str, calendar: DataFrame, start: date | str, end: date | str, n: int) -> DataFrame:
        """Panel rows of ``start`` to ``end`` and at least ``n`` rows of the kind before them, as far as an entity has them.

        The rows of an entity are its latest ones without omission, except that older months without any row of the kind may be left out.
        """
        first = self.first_month(calendar, start, n)
        near = self.rows.filter(f"month BETWEEN {first} AND {month_number(end)} AND trade_date <= DATE'{end}'")
        if n == 0:
            return near.filter(f"trade_date >= DATE'{start}'").drop("month")
        older = materialize(self.older(kind, first, start, end, n))
        # One number per month: bounded by time.
        months = sorted(r[0] for r in older.select("month").distinct().collect())
        if not months:
            return near.drop("month")
        gaps = self.rows.filter(F.col("month").isin(months)).join(older, ["entity", "month"], "left_semi")
        return near.unionByName(gaps.select(*near.columns)).drop("month")


def stored_history(
    panel: DataFrame, kinds: Mapping[str, str], store: Callable[..., DataFrame], columns: Sequence[str] | None = None
) -> History:
    """History kept by ``store(name, build, partition_by=...)``; ``columns`` are computed from those of ``panel`` on reading."""
    rows = store("history_rows", lambda: by_month(panel), partition_by=["month"])
    if columns is not None:
        rows = rows.selectExpr(*columns, "month")
    return History(rows, store("history_counts", lambda: month_counts(rows, kinds)))
