"""Compare registered queries with their SQL on DuckDB (development aid).

Usage: python -m tests.compare SF_DIR [name-prefix ...]
"""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value: object) -> str:
    if value is None:
        return "~"
    if isinstance(value, float):
        if value != value:
            return "nan"
        return repr(value + 0.0)
    return str(value)


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[str, str]:
    start = time.time()
    df = fn(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    joins = [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin") if w in plan]
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return ("rows" if got else "EMPTY"), f"{len(got)} rows {took:.1f}s"
    start = time.time()
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    sql_took = time.time() - start
    note = f"{len(got)} rows {took:.1f}s sql {sql_took:.1f}s {' '.join(joins)}"
    if sorted(df.columns) != sorted(want_cols):
        return "COLUMNS", f"{sorted(set(df.columns) ^ set(want_cols))}"
    a, b = _rows(df.columns, got), _rows(want_cols, want)
    if a == b:
        return ("ok" if got else "EMPTY"), note
    diff = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return "DIFF", f"spark {len(a)} sql {len(b)} {note}\n   cols {sorted(df.columns)}\n   spark {diff[0]}\n   sql   {diff[1]}"


def main() -> int:
    import __spark_entry__ as entry
    from tidemark.session import build_session

    sf_dir, prefixes = sys.argv[1], sys.argv[2:]
    spark = build_session()
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            status, note = compare(spark, con, name, fn, oracle.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            status, note = "ERROR", str(exc)[:900]
        if status not in ("ok", "rows"):
            bad += 1
        print(f"{status:8s} {name:48s} {note}", flush=True)
    print(f"bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
