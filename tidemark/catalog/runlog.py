"""O: run-log picks and fingerprints."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.catalog.registry import cte, query
from tidemark.catalog.universe import names_sql
from tidemark.operators import runlog as rl
from tidemark.session import shared_dir
from tidemark.sources import snapshots

BEFORE = "1999-06-07"
_AT = "coalesce(finished_at, started_at)"
_OK = "coalesce(status, 'succeeded') = 'succeeded' AND run_id IN (SELECT run_id FROM artifacts)"


@query(
    "o1_latest_run_per_kind",
    f"""SELECT kind, {_AT} AS at, run_id FROM runs WHERE {_OK}
        QUALIFY row_number() OVER (PARTITION BY kind ORDER BY {_AT} DESC, run_id) = 1""",
    ["runs", "artifacts"],
)
def _(t):
    return rl.latest_per_kind(t.runs, t.artifacts)


@query(
    "o2_previous_run_per_kind",
    f"""SELECT kind, as_of_date, {_AT} AS at, run_id FROM runs WHERE {_OK} AND as_of_date < DATE '{BEFORE}' AND run_id <> 7
        QUALIFY row_number() OVER (PARTITION BY kind ORDER BY as_of_date DESC, {_AT} DESC, run_id DESC) = 1""",
    ["runs", "artifacts"],
)
def _(t):
    return rl.previous_per_kind(t.runs, t.artifacts, BEFORE, 7)


@query(
    "o3_artifact_bundle",
    """SELECT a.*, r.kind, r.status, r.as_of_date FROM artifacts a JOIN runs r ON r.run_id = a.run_id WHERE r.kind = '1-URGENT'""",
    ["runs", "artifacts"],
)
def _(t):
    return rl.bundle(t.runs, t.artifacts, "1-URGENT")


@query(
    "o3_missing_required_files",
    """SELECT run_id, file_name FROM runs CROSS JOIN (VALUES ('part-1.csv'), ('part-2.csv')) f(file_name)
       WHERE NOT EXISTS (SELECT 1 FROM artifacts a WHERE a.run_id = runs.run_id AND a.path LIKE '%/' || f.file_name)""",
    ["runs", "artifacts"],
)
def _(t):
    return rl.missing_files(t.runs, t.artifacts, ["part-1.csv", "part-2.csv"])


@query(
    "o4_recent_runs",
    f"SELECT run_id, kind, status, {_AT} AS at FROM runs ORDER BY {_AT} DESC NULLS LAST, run_id LIMIT 50",
    ["runs"],
)
def _(t):
    return rl.recent_runs(t.runs, 50)


@query(
    "o4_latest_formal_run",
    f"SELECT run_id, kind, status, {_AT} AS at FROM runs WHERE run_mode = 'formal' ORDER BY {_AT} DESC NULLS LAST, run_id LIMIT 1",
    ["runs"],
)
def _(t):
    return rl.recent_runs(t.runs, 1, formal=True)


@query(
    "o5_artifact_groups",
    """SELECT g.run_id, r.kind, g.directory, artifact_count, row_count, first_file, last_file, coalesce(r.finished_at, newest, r.started_at) AS updated_at
       FROM (SELECT run_id, regexp_replace(path, '/[^/]*$', '') AS directory, count(*) AS artifact_count, sum(row_count) AS row_count,
                    min(split_part(path, '/', -1)) AS first_file, max(split_part(path, '/', -1)) AS last_file, max(created_at) AS newest
             FROM artifacts GROUP BY 1, 2) g LEFT JOIN runs r ON r.run_id = g.run_id""",
    ["runs", "artifacts"],
    longs="row_count",
)
def _(t):
    return rl.artifact_groups(t.runs, t.artifacts)


@query(
    "o5_artifact_rows",
    """SELECT a.run_id, r.kind, r.status, regexp_replace(path, '/[^/]*$', '') AS directory, split_part(path, '/', -1) AS file_name, path,
              row_count, created_at FROM artifacts a LEFT JOIN runs r ON r.run_id = a.run_id""",
    ["runs", "artifacts"],
)
def _(t):
    return rl.artifact_rows(t.runs, t.artifacts)


def _finger_sql(table: str, source: str, dates: list[str], names: list[str]) -> str:
    cells = ["CAST(count(*) AS VARCHAR)"]
    for c in dates:
        cells += [f"coalesce(CAST(min({c}) AS VARCHAR), '')", f"coalesce(CAST(max({c}) AS VARCHAR), '')"]
    cells += [f"coalesce({names_sql(source, c)}, '')" for c in names]
    material = " || '|' || ".join([f"'{table}'", *cells])
    return f"SELECT '{table}' AS table_name, count(*) AS row_count, {material} AS material, sha256({material}) AS fingerprint FROM {source}"


cte(
    "fingers",
    " UNION ALL ".join(
        [
            _finger_sql("daily_prices", "panel", ["trade_date"], []),
            _finger_sql("announcements", "announcements", ["effective_date", "publish_time"], ["source", "source_tag"]),
            _finger_sql("artifacts", "artifacts", ["created_at"], []),
        ]
    ),
    ["panel", "announcements", "artifacts"],
)


def fingerprints(t):
    return [
        rl.table_fingerprint(t.prices, "daily_prices"),
        rl.table_fingerprint(t.announcements, "announcements"),
        rl.table_fingerprint(t.artifacts, "artifacts"),
    ]


@query("o6_table_fingerprints", "SELECT * FROM fingers", ["fingers"])
def _(t):
    a, b, c = fingerprints(t)
    return a.unionByName(b).unionByName(c)


@query("o6_stored_fingerprint", "SELECT * FROM fingers WHERE table_name = 'announcements'", ["fingers"])
def _(t):
    """Announcements stored year by year; each append adds the digest of its own group."""
    rows, spark = t.announcements, t.spark
    path = f"{shared_dir(spark)}/announcements-{uuid.uuid4().hex}"
    years = sorted((r[0] for r in rows.selectExpr("year(publish_time)").distinct().collect()), key=lambda y: (y is not None, y))
    for year in years:
        part = rows.filter(F.expr("year(publish_time)").eqNullSafe(F.lit(year)))
        snapshots.add(part, snapshots.current(spark, path), ["publish_time"])
        finger = rl.stored_fingerprint(spark, path, rows.schema, "announcements")
    return finger if years else rl.table_fingerprint(rows, "announcements")


@query(
    "o7_snapshot_id",
    "SELECT sha256(string_agg(table_name || ':' || fingerprint, '|' ORDER BY table_name)) AS snapshot_id, count(*) AS table_count FROM fingers",
    ["fingers"],
)
def _(t):
    return rl.snapshot_id(fingerprints(t))
