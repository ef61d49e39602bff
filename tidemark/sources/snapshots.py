"""Tables of files with versions: a commit is one rename of a small manifest, and readers resolve the newest one.

A table is a folder with ``groups`` (folders of Parquet files, never changed), ``keys`` (a key filter per group) and ``versions``
(one JSON manifest per version, which lists the groups that make up the table).  Writing prepares groups first and
then publishes the next version's manifest under a name that must not exist yet.  Whoever stops before that rename has changed nothing;
whoever comes second finds the name taken and gets :class:`Conflict`, so a check made against one version holds for the commit that follows it.

The key filter of a group is a Bloom filter in blocks of 256 bits, itself a table: one row per block.  Keys look up their block by an equi-join, so
neither filters nor keys pass through the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialize

# Keys of a filter block: 256 bits, of which a key sets eight.
BLOCK_KEYS = 16
WORDS = 4
# Column, and so folder, of a bucketed table's buckets.
BUCKET = "tidemark_bucket"


# Name of the group that a row was read from.
GROUP_OF_ROW = "regexp_extract(_metadata.file_path, '.*/groups/(.+)/[^/]+$', 1) AS group"


class Conflict(RuntimeError):
    """Another writer has published a version since the one this commit started from."""


@dataclass(frozen=True)
class Group:
    """One written folder: its rows, the least and greatest value of some columns as text, its key filter and its bucket, if any."""

    name: str
    rows: int
    low: dict[str, str | None] = field(default_factory=dict)
    high: dict[str, str | None] = field(default_factory=dict)
    blocks: int = 0
    bucket: int | None = None


@dataclass(frozen=True)
class Snapshot:
    """Version 0 is the table before its first commit.

    ``batches`` holds the last batch of each stream that the version contains, ``buckets`` the number of buckets of a bucketed table.
    """

    path: str
    version: int
    groups: tuple[Group, ...]
    batches: dict[str, int] = field(default_factory=dict)
    buckets: int = 0

    def read(self, spark: SparkSession, schema, groups: Sequence[Group] | None = None) -> DataFrame:
        """Rows of all or of some groups; no groups give no rows."""
        chosen = self.groups if groups is None else groups
        if not chosen:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*[f"{self.path}/groups/{g.name}" for g in chosen])


def file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    at, files = file_system(spark, f"{path}/versions")
    if not files.exists(at):
        return []
    names = (status.getPath().getName() for status in files.listStatus(at))
    return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())


def _manifest(path: str, version: int) -> str:
    return f"{path}/versions/{version:020d}.json"


def current(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The newest version of the table at ``path``, or the given one."""
    if version is None:
        version = max(versions(spark, path), default=0)
    if version == 0:
        return Snapshot(path, 0, ())
    text = "".join(r[0] for r in spark.read.text(_manifest(path, version), wholetext=True).collect())
    found = json.loads(text)
    return Snapshot(path, version, tuple(Group(**g) for g in found["groups"]), found["batches"], found["buckets"])


def exists(spark: SparkSession, path: str) -> bool:
    return bool(versions(spark, path))


def publish(spark: SparkSession, base: Snapshot, groups: Sequence[Group], batches: dict[str, int] | None = None, buckets: int = 0) -> Snapshot:
    """Make ``groups`` the version after ``base``; all their files are written already.  ``batches`` are added to those of ``base``."""
    after = Snapshot(base.path, base.version + 1, tuple(groups), base.batches | (batches or {}), buckets or base.buckets)
    aside, files = file_system(spark, f"{base.path}/versions/.{uuid.uuid4().hex}")
    target, _ = file_system(spark, _manifest(base.path, base.version + 1))
    out = files.create(aside, False)
    manifest = {"groups": [asdict(g) for g in after.groups], "batches": after.batches, "buckets": after.buckets}
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    _rename_once(spark, aside, target)
    return after


def _rename_once(spark: SparkSession, source, target) -> None:
    """Rename that fails if the target exists."""
    jvm = spark._jvm
    none = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = none
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(source, target, options)
    except Exception as failed:
        if "FileAlreadyExists" in str(failed):
            raise Conflict(f"{target.toString()} was published by another writer") from failed
        raise


# ---- key filters ----------------------------------------------------------


def _block(keys: Sequence[str], blocks: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), blocks)


def _masks(keys: Sequence[str]) -> list[Column]:
    """Two bits in each of the block's words, from a second hash."""
    bits = F.xxhash64(F.lit(1), *keys)
    one = F.lit(1).cast("long")
    bit = lambda i: F.call_function("shiftleft", one, F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(WORDS)]


def key_filter(df: DataFrame, keys: Sequence[str], blocks: int) -> DataFrame:
    """``block, w0 ... w3``: the bits of all keys of a block; combines before the shuffle."""
    masks = [mask.alias(f"m{w}") for w, mask in enumerate(_masks(keys))]
    return (
        df.select(_block(keys, F.lit(blocks)).alias("block"), *masks)
        .groupBy("block")
        .agg(*[F.bit_or(f"m{w}").alias(f"w{w}") for w in range(WORDS)])
    )


def inside(group: Group, kinds: dict[str, str]) -> Column:
    """Can the row lie in the group, by its bounds?"""
    rule = F.lit(True)
    for name, low in group.low.items():
        if low is not None:
            column = F.col(name)
            rule &= column.isNull() | column.between(F.lit(low).cast(kinds[name]), F.lit(group.high[name]).cast(kinds[name]))
    return rule


def possible(spark: SparkSession, snapshot: Snapshot, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, group``: the keys of ``rows`` that the bounds and filters of a group do not exclude; few others than the real ones."""
    kinds = dict(rows.dtypes)
    near = _overlapping(snapshot, rows, keys)
    if not near:
        return rows.limit(0).select(*keys, F.lit("").alias("group"))
    listed = F.array(*[F.when(inside(g, kinds), F.struct(F.lit(g.name).alias("group"), F.lit(g.blocks).alias("blocks"))) for g in near])
    looked = rows.select(*keys, *[m.alias(f"m{w}") for w, m in enumerate(_masks(keys))], F.explode(F.array_compact(listed)).alias("g"))
    looked = looked.select("*", "g.group", _block(keys, F.col("g.blocks")).alias("block")).drop("g")
    found = None
    for g in near:
        if not g.blocks:
            hit = looked.filter(F.col("group") == g.name).select(*keys, "group")
            found = hit if found is None else found.unionByName(hit)
    filtered = [g for g in near if g.blocks]
    if filtered:
        words = ", ".join(f"w{w} BIGINT" for w in range(WORDS))
        folders = [f"{snapshot.path}/keys/{g.name}" for g in filtered]
        bits = spark.read.schema(f"block BIGINT, {words}, group STRING").parquet(*folders)
        every = " AND ".join(f"w{w} & m{w} = m{w}" for w in range(WORDS))
        hit = looked.join(bits, ["group", "block"]).filter(every).select(*keys, "group")
        found = hit if found is None else found.unionByName(hit)
    return found


def _overlapping(snapshot: Snapshot, rows: DataFrame, columns: Sequence[str]) -> list[Group]:
    """Groups whose bounds meet those of ``rows``; columns without bounds do not decide."""
    spark, kinds = rows.sparkSession, dict(rows.dtypes)
    ends = rows.agg(*[f(c).cast("string").alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))]).first()
    meets = []
    for i, g in enumerate(snapshot.groups):
        rule = F.lit(True)
        for c in (c for c in columns if g.low.get(c) is not None and ends[f"low_{c}"] is not None):
            low, high, first, last = (F.lit(v).cast(kinds[c]) for v in (g.low[c], g.high[c], ends[f"low_{c}"], ends[f"high_{c}"]))
            rule &= (low <= last) & (first <= high)
        meets.append(rule.alias(str(i)))
    found = spark.range(1).select(*meets).first() if meets else []
    return [g for g, yes in zip(snapshot.groups, found) if yes]


def stored_keys(spark: SparkSession, snapshot: Snapshot, rows: DataFrame, keys: Sequence[str], schema) -> DataFrame:
    """The distinct keys of ``rows`` that the snapshot holds.  Only groups that a key may lie in are read, and no group if there is no such key."""
    candidates = materialize(possible(spark, snapshot, rows.select(*keys).distinct(), keys))
    names = {r[0] for r in candidates.select("group").distinct().collect()}
    wanted = candidates.select(*keys).distinct()
    if not names:
        return wanted
    held = snapshot.read(spark, schema, [g for g in snapshot.groups if g.name in names])
    return wanted.join(held.select(*keys), list(keys), "left_semi")


def holding(snapshot: Snapshot, rows: DataFrame, columns: Sequence[str], schema) -> list[Group]:
    """Groups that hold a row with the same ``columns`` as a row of ``rows``; those that bounds exclude are not read."""
    spark = rows.sparkSession
    near = _overlapping(snapshot, rows, columns)
    if not near:
        return []
    held = snapshot.read(spark, schema, near).selectExpr(*columns, GROUP_OF_ROW)
    names = {r[0] for r in held.join(rows.select(*columns).distinct(), list(columns), "left_semi").select("group").distinct().collect()}
    return [g for g in near if g.name in names]


def holding_where(spark: SparkSession, snapshot: Snapshot, condition: str, schema) -> list[Group]:
    """Groups that hold a row for which the SQL condition is true."""
    names = {r[0] for r in snapshot.read(spark, schema).filter(condition).selectExpr(GROUP_OF_ROW).distinct().collect()} if snapshot.groups else set()
    return [g for g in snapshot.groups if g.name in names]


# ---- writing --------------------------------------------------------------


def write_group(df: DataFrame, path: str, bounds: Sequence[str] = (), keys: Sequence[str] = ()) -> Group:
    """Write rows, and the filter of their keys, as a new group that no version lists yet.

    Rows are counted and bounded while they are written; the filter is made from the written keys.
    """
    spark, name, seen = df.sparkSession, uuid.uuid4().hex, Observation()
    ends = [f(c).cast("string").alias(f"{n}_{c}") for c in bounds for n, f in (("low", F.min), ("high", F.max))]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *ends).write.parquet(f"{path}/groups/{name}")
    found = seen.get
    blocks = -(-found["rows"] // BLOCK_KEYS) if keys else 0
    if blocks:
        written = spark.read.schema(df.schema).parquet(f"{path}/groups/{name}")
        key_filter(written, keys, blocks).withColumn("group", F.lit(name)).write.parquet(f"{path}/keys/{name}")
    return Group(name, found["rows"], {c: found[f"low_{c}"] for c in bounds}, {c: found[f"high_{c}"] for c in bounds}, blocks)


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> list[Group]:
    """Write rows as one group per bucket of their keys, in one job; no version lists them yet."""
    spark, name = df.sparkSession, uuid.uuid4().hex
    at = f"{path}/groups/{name}"
    df.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(at)
    # Counted from the files' footers; one number a bucket.
    counts = spark.read.schema(f"{BUCKET} INT").parquet(at).groupBy(BUCKET).count().collect()
    return [Group(f"{name}/{BUCKET}={b}", n, bucket=b) for b, n in sorted(tuple(r) for r in counts)]


def replace(df: DataFrame, path: str, bounds: Sequence[str] = (), keys: Sequence[str] = (), base: Snapshot | None = None, dropped: Sequence[Group] | None = None) -> Snapshot:
    """Publish ``df`` in place of the ``dropped`` groups of ``base``, by default of all; ``df`` may read them, as their files stay.

    ``base`` is the version that ``df`` was made from, by default the newest one.
    """
    spark = df.sparkSession
    base = base or current(spark, path)
    dropped = base.groups if dropped is None else dropped
    group = write_group(df, path, bounds, keys)
    return publish(spark, base, [*[g for g in base.groups if g not in dropped], *([group] if group.rows else [])])


def add(df: DataFrame, base: Snapshot, bounds: Sequence[str] = (), keys: Sequence[str] = ()) -> Snapshot:
    """Add the rows of ``df`` to the version ``base``."""
    return replace(df, base.path, bounds, keys, base, dropped=())


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest version of the table at ``path``."""
    return current(spark, path).read(spark, schema)


def expire(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete all but the newest ``keep`` versions and the groups that only they list; readers of these lose their files.

    Groups that no version lists, left by failed writes, go as well, so nothing may be written meanwhile.
    """
    known = versions(spark, path)
    old, kept = known[:-keep], known[-keep:]
    used = {g.name for v in kept for g in current(spark, path, v).groups}
    folders = {name.split("/")[0] for name in used}
    gone = []
    for v in old:
        at, files = file_system(spark, _manifest(path, v))
        files.delete(at, False)
    for part in ("groups", "keys"):
        at, files = file_system(spark, f"{path}/{part}")
        for status in files.listStatus(at) if files.exists(at) else []:
            name = status.getPath().getName()
            if name not in folders:
                files.delete(status.getPath(), True)
                gone.append(name)
            elif name not in used:  # written as buckets, some of which are in use
                for bucket in files.listStatus(status.getPath()):
                    inner = f"{name}/{bucket.getPath().getName()}"
                    if bucket.isDirectory() and inner not in used:
                        files.delete(bucket.getPath(), True)
                        gone.append(inner)
    return sorted(set(gone))
