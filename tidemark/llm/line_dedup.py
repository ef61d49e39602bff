"""Line deduplication over levelled, sorted runs of line hashes.

A store keeps runs: tables bucketed and sorted by a 128-bit line hash, each hash in
one run only.  A batch of documents is reduced to its distinct hashes, merge-anti-joined with every run
(no shuffle of the run), and the rest becomes a new run of level 0.  When a level holds ``fan_in``
runs, they are compacted into one run of the next level, so a store of n batches has about
``fan_in * log(n)`` runs.  Batches arrive in ascending document order, therefore a hash that a run
already holds belongs to an earlier document.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ASCII_SPACE, NO_ID, ascii_lower, join_counted, read
from tidemark.session import materialize, shared_dir

MIN_CHARS = 10
BATCHES = 3
FAN_IN = 2
HASH = ["h1", "h2"]


@dataclass
class LineStore:
    """Runs of ``h1, h2, first, last, n`` by level; tables lie in the shared folder."""

    spark: SparkSession
    fan_in: int = FAN_IN
    levels: list[list[str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.root = f"{shared_dir(self.spark)}/line-runs-{uuid.uuid4().hex}"

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            run.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.root}/{name}").saveAsTable(name)
        )
        return name

    def _push(self, name: str, level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)

    def compact(self) -> None:
        """Merge every full level into one run of the next."""
        level = 0
        while level < len(self.levels):
            names = self.levels[level]
            if len(names) >= self.fan_in:
                merged = self.spark.table(names[0])
                for name in names[1:]:
                    merged = merged.unionByName(self.spark.table(name))
                self.levels[level] = []
                self._push(self._write(merged.repartition(self.buckets, *HASH)), level + 1)
                for name in names:
                    self.spark.sql(f"DROP TABLE {name}")
            level += 1

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch of ``id, row, pos, h1, h2`` and return the ``id, row, pos`` of its repeated lines."""
        keys = lines.groupBy(*HASH).agg(
            F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")
        )
        fresh, known = keys, None
        for run in self.runs():
            fresh = fresh.join(run.select(*HASH), HASH, "left_anti")
            hit = keys.join(run.select(*HASH), HASH, "left_semi")
            known = hit if known is None else known.unionByName(hit)
        own = self._write(fresh)
        repeated = self.spark.table(own).filter("first < last").select(*HASH, "first", "n")
        if known is not None:
            # Held by an earlier batch: every line of this batch goes.
            repeated = repeated.unionByName(known.selectExpr(*HASH, "CAST(NULL AS BIGINT) AS first", "n"))
        repeated = materialize(repeated)
        dropped = materialize(
            join_counted(lines, repeated, HASH, "n", lines.count())
            .filter("first IS NULL OR id > first")
            .select("id", "row", "pos")
        )
        self._push(own)
        self.compact()
        return dropped

    def close(self) -> None:
        """Forget the tables; their files stay in the shared folder."""
        for name in [name for level in self.levels for name in level]:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = []


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``id, row, pos, h1, h2`` of all lines whose key has at least ``min_chars`` code points.

    ``docs`` has ``id, row, text``.  The hash is 128 bits wide, from two differently seeded XXH64.
    """
    return (
        docs.select("id", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .withColumn("line", ascii_lower(F.btrim("line", F.lit(ASCII_SPACE))))
        .filter(F.char_length("line") >= min_chars)
        .select("id", "row", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    )


def dedup_lines(
    docs: DataFrame,
    batches: int = BATCHES,
    min_chars: int = MIN_CHARS,
    store: LineStore | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept``: each text without the lines that an earlier document holds.

    ``docs`` needs ``doc_id`` and ``text``; of other columns those in ``keep`` stay, the rest is not read.  A line's key is the line without
    ASCII white space at its ends and with A-Z lower-cased.  Keys shorter than ``min_chars`` stay.  Null text
    is the empty text, which is one empty line.  Rows with equal doc_id (told apart by a hash of their text) are one document: none of them drops a
    line for the sake of another.  Rows without doc_id are one document after all others.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    source = docs.select(
        "doc_id",
        F.coalesce("doc_id", F.lit(NO_ID)).alias("id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.struct(F.lit(0).alias("_"), *keep).alias("carried"),
    ).withColumn("row", F.xxhash64("text"))
    store = store or LineStore(spark)
    # Borders of the batches: a few quantiles of doc_id.
    share = [F.lit((i + 1) / batches) for i in range(batches - 1)]
    borders = sorted(set(source.agg(F.percentile_approx("id", F.array(*share))).first()[0] or [])) if share else []
    batch = sum((F.col("id") > border).cast("int") for border in borders) if borders else F.lit(0)
    lines = materialize(hashed_lines(source, min_chars).withColumn("batch", batch), "batch")
    dropped = None
    for i in range(len(borders) + 1):
        part = store.add(lines.filter(F.col("batch") == i).select("id", "row", "pos", *HASH))
        dropped = part if dropped is None else dropped.unionByName(part)
    store.close()
    gone = dropped.groupBy("id", "row").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    # The kept lines lie between neighbouring dropped positions, so cutting is linear in the number of lines.
    kept = F.expr(
        "flatten(transform(sequence(0, size(gone)), k -> slice(lines,"
        " CASE WHEN k = 0 THEN 1 ELSE gone[k - 1] + 2 END,"
        " CASE WHEN k = size(gone) THEN n_lines ELSE gone[k] END - CASE WHEN k = 0 THEN 0 ELSE gone[k - 1] + 1 END)))"
    )
    return (
        source.join(gone, ["id", "row"], "left")
        .select("doc_id", "text", "gone", "carried", F.split("text", "\n", -1).alias("lines"))
        .withColumn("n_lines", F.size("lines"))
        .select(
            "doc_id",
            F.col("n_lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
            F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept"),
            *[F.col(f"carried.{c}") for c in keep],
        )
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


ORACLE = """
WITH lines AS (
  SELECT doc_id, pos, parts[pos] AS line,
         translate(trim(parts[pos], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), owners AS (
  SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT l.doc_id, l.pos, l.line, o.owner IS NOT NULL AND o.owner < l.doc_id AS dropped
  FROM lines l LEFT JOIN owners o ON l.key = o.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
