"""Session defaults and the places where intermediate tables are written."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

# Used by sessions of build_session on local masters whose configuration names no folder.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
_LOCAL_RUNS: set[str] = set()
# Tables in the catalog that clean_up drops: those of :func:`stored`, and runs of lines that a failed job has left.
TABLE_PREFIX = "stored_"
DROPPED = (TABLE_PREFIX, "line_run_")
# Folders of more files than this are listed by a job instead of file by file.
LISTED_FILES = 200
# Application id -> this run's folder below the shared one, and tables stored once per run by key.
_FOLDERS: dict[str, str] = {}
_STORED: dict[tuple[str, str], Callable[[], DataFrame]] = {}


def build_session(app: str = "tidemark", master: str | None = None, cores: int | None = None) -> SparkSession:
    """Session for tests and the benchmark; a cluster job brings its own session."""
    cores = cores or os.cpu_count() or 8
    builder = (
        SparkSession.builder.appName(app)
        .master(master or f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not _checkpoint_dir(spark):
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _LOCAL_RUNS.add(spark.sparkContext.applicationId)
    return spark


def _checkpoint_dir(spark: SparkSession) -> str | None:
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return configured or (LOCAL_CHECKPOINTS if spark.sparkContext.applicationId in _LOCAL_RUNS else None)


def files_state(spark: SparkSession, paths: Sequence[str]) -> str:
    """A text that changes when files below ``paths`` are added, removed, replaced or rewritten: names, sizes and modification times."""
    found = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(at):
            continue
        statuses = files.listStatus(at)
        if len(statuses) <= LISTED_FILES and not any(s.isDirectory() for s in statuses):
            found += sorted(f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}" for s in statuses)
            continue
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        row = listed.selectExpr("count(*)", "sum(length)", "sum(CAST(xxhash64(path, length, modificationTime) AS DECIMAL(38,0)))").first()
        found.append(f"{path}:{row[0]}:{row[1]}:{row[2]}")
    return hashlib.sha256("\n".join(found).encode()).hexdigest()


def shared_dir(spark: SparkSession) -> str:
    """This run's folder for intermediate tables, below the session's ``spark.checkpoint.dir``.

    The setting must be there: a machine-local folder would be invisible to other executors.
    """
    configured = _checkpoint_dir(spark)
    if not configured:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    run = spark.sparkContext.applicationId
    if run not in _FOLDERS:
        _FOLDERS[run] = f"{configured.rstrip('/')}/tidemark-{run}-{uuid.uuid4().hex[:8]}"
    return _FOLDERS[run]


def materialize(df: DataFrame, *partition_by: str, plain: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This runs a job at once, while the caller's plan is still being built.  Used where several branches of one plan
    read the same costly intermediate.  The table is durable, so a lost executor
    costs a re-read and not a recomputation, and the scan that follows prunes
    columns and knows its size, which lets Spark choose its join strategy.  Spark takes the size of the files for that of the rows:
    ``plain`` writes keys, of which millions shrink to a few MB, without compression, so that they are not broadcast as a small table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists").partitionBy(*partition_by)
    if plain:
        writer = writer.option("compression", "uncompressed").option("parquet.enable.dictionary", "false")
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(
    spark: SparkSession, key: str, build: Callable[[], DataFrame], bucket_by: str | None = None, partition_by: Sequence[str] = (),
    plain: bool = False,
) -> DataFrame:
    """The table of ``key``, built and written at its first use in this run and read by every later query.

    ``key`` must name the data, by the state of its files (see :func:`files_state`), and all parameters.  With ``bucket_by`` the table is
    bucketed and sorted by that column, so that joins, aggregations and windows over it need no shuffle.
    """
    at = (spark.sparkContext.applicationId, key)
    if at not in _STORED:
        if bucket_by is None:
            df = materialize(build(), *partition_by, plain=plain)
            _STORED[at] = lambda: df
        else:
            name, df = f"{TABLE_PREFIX}{uuid.uuid4().hex}", build()
            buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
            writer = df.repartition(buckets, bucket_by).write.bucketBy(buckets, bucket_by).sortBy(bucket_by)
            writer.option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
            _STORED[at] = lambda: spark.table(name)
    return _STORED[at]()


def clean_up(spark: SparkSession) -> None:
    """Delete everything this run has written to the shared folder; frames that read it become invalid."""
    run = spark.sparkContext.applicationId
    for at in [at for at in _STORED if at[0] == run]:
        del _STORED[at]
    for table in spark.catalog.listTables():
        if table.name.startswith(DROPPED):
            spark.sql(f"DROP TABLE IF EXISTS {table.name}")
    folder = _FOLDERS.pop(run, None)
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
