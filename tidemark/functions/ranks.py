"""Exact cross-sectional order statistics that never gather a group in one task.

A window over ``(date)`` or ``(date, factor)`` sends a whole cross-section to a
single task.  The functions here cut every large group into ordered slices
instead.  Slice borders come from a hash sample of the sort keys, so they are
the same on every recomputation; ranks stay exact because each slice adds the
total weight of the slices before it.  A group too small to have sampled
borders is one slice, and the join with the (empty) border table is removed by
adaptive execution.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Expected number of sort keys per slice.
SLICE_ROWS = 250_000


def _list(names: Sequence[str]) -> str:
    return ", ".join(names)


def largest_group(df: DataFrame, groups: Sequence[str]) -> int:
    """Rows of the largest group, by one small job over a written table.

    Callers hand the result to the functions below: groups known to fit into one slice are ordered by
    plain windows, which need one shuffle and no joins.  Results are the same either way.
    """
    return df.groupBy(*groups).count().agg(F.max("count")).first()[0] or 0


def ordered_positions(
    df: DataFrame,
    groups: Sequence[str],
    keys: Sequence[str],
    weight: str | None = None,
    before: str = "_before",
    total: str = "_total",
    slice_rows: int = SLICE_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Add the weight strictly before each row and the weight of its group.

    ``keys`` ascend and must be unique in a group (ties are collapsed first by
    :func:`value_positions`).  Without ``weight`` every row counts as one, so
    ``before + 1`` is the row number.
    """
    g, k = _list(groups), _list(keys)
    w = weight or "1L"
    if largest is not None and largest <= slice_rows:
        up_to = f"OVER (PARTITION BY {g} ORDER BY {k} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        return df.selectExpr(
            "*", f"coalesce(sum({w}) {up_to}, 0L) AS {before}", f"sum({w}) OVER (PARTITION BY {g}) AS {total}"
        )
    borders = (
        df.filter(f"pmod(xxhash64({g}, {k}), {slice_rows}) = 0")
        .groupBy(*groups)
        .agg(F.expr(f"array_sort(collect_list(struct({k}, {w} AS _w))) AS _borders"))
    )
    border = f"struct({_list([f'get(_borders, low + step - 1).{name}' for name in keys])})"
    # Binary search: 20 steps reach a million borders, which is SLICE_ROWS million rows in one group.
    steps = f"array({_list([str(1 << i) for i in reversed(range(20))])})"
    search = (
        f"aggregate({steps}, 0, (low, step) -> CASE WHEN low + step <= size(_borders) AND {border} < struct({k})"
        " THEN low + step ELSE low END)"
    )
    sliced = df.join(borders, list(groups), "left").selectExpr(
        *df.columns, f"CASE WHEN _borders IS NULL THEN 0 ELSE {search} END AS _slice"
    )
    slices = (
        sliced.groupBy(*groups, "_slice")
        .agg(F.expr(f"sum({w}) AS _weight"))
        .selectExpr(
            *groups,
            "_slice",
            f"coalesce(sum(_weight) OVER (PARTITION BY {g} ORDER BY _slice "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS _offset",
            f"sum(_weight) OVER (PARTITION BY {g}) AS {total}",
        )
    )
    local = (
        f"coalesce(sum({w}) OVER (PARTITION BY {g}, _slice ORDER BY {k} "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)"
    )
    return (
        sliced.selectExpr("*", f"{local} AS _local")
        .join(slices, [*groups, "_slice"])
        .selectExpr(*df.columns, f"_local + _offset AS {before}", total)
    )


def value_positions(
    df: DataFrame, groups: Sequence[str], value: str, slice_rows: int = SLICE_ROWS, largest: int | None = None
) -> DataFrame:
    """Distinct non-null values per group with count, rows before and group size.

    Ties collapse in the partial aggregation, so one value held by a third of
    all rows becomes one row before anything is sorted.
    """
    counts = df.filter(f"{value} IS NOT NULL").groupBy(*groups, value).agg(F.expr("count(*) AS _count"))
    return ordered_positions(counts, groups, [value], "_count", slice_rows=slice_rows, largest=largest)


# Average rank (1-based) of a tied value, over the columns of value_positions.
AVERAGE_RANK = "_before + (_count + 1) / 2"


def with_average_rank(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    rank: str,
    size: str | None = None,
    slice_rows: int = SLICE_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Add the average rank of ``value`` in its group, and the group's size (of rows with a value)."""
    if largest is not None and largest <= slice_rows:
        g = _list(groups)
        average = (
            f"CASE WHEN {value} IS NOT NULL THEN rank() OVER (PARTITION BY {g} ORDER BY {value} NULLS LAST)"
            f" + (count(*) OVER (PARTITION BY {g}, {value}) - 1) / 2 END AS {rank}"
        )
        sized = [f"CASE WHEN {value} IS NOT NULL THEN count({value}) OVER (PARTITION BY {g}) END AS {size}"] if size else []
        return df.selectExpr("*", average, *sized)
    ranks = value_positions(df, groups, value, slice_rows).selectExpr(
        *groups, value, f"{AVERAGE_RANK} AS {rank}", *([f"_total AS {size}"] if size else [])
    )
    return df.join(ranks, [*groups, value], "left")


def correlation(x: str, y: str) -> str:
    """SQL for Pearson correlation by moments; NULL when either side is constant.

    Rounded to twelve decimals, so that a zero correlation has no sign from the
    order in which partial sums were merged.
    """
    return (
        f"CASE WHEN max({x}) > min({x}) AND max({y}) > min({y}) "
        f"THEN round(try_divide(covar_pop({x}, {y}), stddev_pop({x}) * stddev_pop({y})), 12) END"
    )


def row_numbers(
    df: DataFrame, groups: Sequence[str], keys: Sequence[str], out: str = "rank", size: str = "group_size",
    slice_rows: int = SLICE_ROWS, largest: int | None = None,
) -> DataFrame:
    """Exact row number per group over unique ascending keys, plus group size."""
    placed = ordered_positions(df, groups, keys, total=size, slice_rows=slice_rows, largest=largest)
    return placed.selectExpr(*df.columns, f"_before + 1 AS {out}", size)


def quantiles(
    df: DataFrame, groups: Sequence[str], value: str, points: dict[str, float], slice_rows: int = SLICE_ROWS, largest: int | None = None
) -> DataFrame:
    """Exact linear-interpolation quantiles per group.

    Reads them off the cumulative counts, so no task holds a group's values.
    """
    return several_quantiles(df, groups, {value: points}, slice_rows, largest)


def several_quantiles(
    df: DataFrame, groups: Sequence[str], wanted: Mapping[str, Mapping[str, float]], slice_rows: int = SLICE_ROWS, largest: int | None = None
) -> DataFrame:
    """:func:`quantiles` of several columns in one pass: ``wanted`` maps a column to its points by output name.

    The columns are stacked and their number joins the group, so all values are counted, ordered and read off together.
    Groups without a value in any column have no row; ``largest`` bounds the rows of a group.
    """
    stacked = ", ".join(f"{i}, {value}" for i, value in enumerate(wanted))
    rows = df.selectExpr(*groups, f"stack({len(wanted)}, {stacked}) AS (_column, _value)")
    pos = value_positions(rows, [*groups, "_column"], "_value", slice_rows, largest)
    aggs, out = [], []
    for i, points in enumerate(wanted.values()):
        for name, q in points.items():
            at = f"(_total - 1) * {float(q)}D"
            for side, index in (("lo", f"floor({at})"), ("hi", f"ceil({at})")):
                inside = f"_column = {i} AND _before <= {index} AND {index} < _before + _count"
                aggs.append(F.expr(f"max(CASE WHEN {inside} THEN _value END) AS _{name}_{side}"))
            aggs.append(F.expr(f"max(CASE WHEN _column = {i} THEN {at} - floor({at}) END) AS _{name}_w"))
            out.append(f"_{name}_lo + (_{name}_hi - _{name}_lo) * _{name}_w AS {name}")
    return pos.groupBy(*groups).agg(*aggs).selectExpr(*groups, *out)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first in ``order`` with NULLs last.

    A struct minimum combines map-side, so a key that owns a third of the rows
    costs one partial row per task where ``row_number`` would sort it in one.
    Order items are column names; ``"name DESC"`` works for dates and numbers.
    """
    kinds = dict(df.dtypes)
    parts = []
    for i, item in enumerate(order):
        name, _, down = item.partition(" ")
        column = f"`{name}`"
        if down == "DESC":
            column = f"datediff(DATE'1970-01-01', {column})" if kinds[name] == "date" else f"-{column}"
        parts += [f"`{name}` IS NULL AS n{i}", f"{column} AS k{i}"]
    payload = [f"`{c}`" for c in df.columns if c not in keys]
    best = F.expr(f"min(struct({_list(parts)}, struct({_list(payload)}) AS row)) AS _best")
    return df.groupBy(*keys).agg(best).selectExpr(
        *[f"`{c}`" if c in keys else f"_best.row.`{c}`" for c in df.columns]
    )
