"""Scalar rules as SQL expression text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Accepted spellings.
TRUE_WORDS = ("true", "1", "yes", "y", "是", "开市", "交易")
FALSE_WORDS = ("false", "0", "no", "n", "否", "休市", "停牌")


def blank_to_null(x: str) -> str:
    return f"nullif(trim({x}), '')"


def _canonical(x: str) -> str:
    return f"replace(upper(trim(CAST({x} AS STRING))), '_', '.')"


def stock_code(x: str) -> str:
    """``NNNNNN.SH|SZ|BJ`` from five spellings, NULL for anything else."""
    s = _canonical(x)
    return (
        f"CASE WHEN {s} RLIKE '^[0-9]{{6}}[.]?(SH|SZ|BJ)$' THEN concat(left({s}, 6), '.', right({s}, 2)) "
        f"WHEN {s} RLIKE '^(SH|SZ|BJ)[0-9]{{6}}$' THEN concat(right({s}, 6), '.', left({s}, 2)) "
        f"WHEN {s} RLIKE '^6[0-9]{{5}}$' THEN concat({s}, '.SH') "
        f"WHEN {s} RLIKE '^[03][0-9]{{5}}$' THEN concat({s}, '.SZ') "
        f"WHEN {s} RLIKE '^[489][0-9]{{5}}$' THEN concat({s}, '.BJ') END"
    )


def index_code(x: str) -> str:
    s = _canonical(x)
    return (
        f"CASE WHEN {blank_to_null(x)} IS NULL THEN NULL WHEN {s} RLIKE '^[0-9]{{6}}$' THEN concat({s}, '.SH') "
        f"WHEN {s} RLIKE '^[0-9]{{6}}[.](SH|SZ|BJ)$' THEN {s} ELSE trim({x}) END"
    )


def exchange(code: str) -> str:
    return f"CASE right(upper({code}), 3) WHEN '.SH' THEN 'SHSE' WHEN '.SZ' THEN 'SZSE' WHEN '.BJ' THEN 'BSE' END"


def to_bool(x: str) -> str:
    def words(values: tuple[str, ...]) -> str:
        return ", ".join(f"'{v}'" for v in values)

    s = f"lower(trim(CAST({x} AS STRING)))"
    return f"CASE WHEN {s} IN ({words(TRUE_WORDS)}) THEN true WHEN {s} IN ({words(FALSE_WORDS)}) THEN false END"


def stable_id(*fields: str) -> str:
    """SHA-1 over '|'-joined fields; missing fields count as empty."""
    parts = ", ".join(f"coalesce(CAST({f} AS STRING), '')" for f in fields)
    return f"sha1(concat_ws('|', {parts}))"


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def normalize_text(df: DataFrame, column: str, out: str) -> DataFrame:
    """Drop a BOM, apply NFKC, collapse white space and trim.

    ASCII text is its own NFKC form; only other text crosses to Python, in
    Arrow batches.
    """
    bare = f"CASE WHEN startswith({column}, '﻿') THEN substring({column}, 2) ELSE {column} END"
    with_bare = df.selectExpr("*", f"{bare} AS _bare").selectExpr(
        "*", "CASE WHEN _bare RLIKE '[^\\\\x00-\\\\x7F]' THEN _bare END AS _wide"
    )
    return (
        with_bare.withColumn("_form", _nfkc(F.col("_wide")))
        .selectExpr(
            *df.columns, f"trim(regexp_replace(coalesce(_form, _bare), '(?U)\\\\s+', ' ')) AS {out}"
        )
    )


def text_hash(normalized: str) -> str:
    return f"sha2({normalized}, 256)"
