"""Merkle manifest of a dataset with incremental witnesses.

Every row is a leaf, and there is a tree per key whose leaves ascend by an order column.  A tree is grown by appending: complete subtrees that
have no partner yet are open, and every leaf carries a partial witness, the siblings met so far.  When two open subtrees of equal
height meet they become one, and the witnesses below them are extended by each other's root; they are never computed anew.

Spark deals the appends out in aligned blocks of ``2 ** HEIGHT`` leaves.  A block is appended in one task; its root is one leaf of the level above,
and those block roots are further appends, until one block holds a whole tree.  Going down again, the witnesses of a block's root extend those of
its leaves.  As blocks are aligned, a later batch rebuilds only the last, unfilled block of each level of a tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, read
from tidemark.session import materialize

# A block has up to 2 ** HEIGHT leaves, each with at most 32 * HEIGHT bytes of witness.
HEIGHT = 10
# Rows of a range of the numbering.
RANGE_ROWS = 1_000_000
# Key of the only tree whose leaves are the roots of the other trees.
TOP = "*"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _hash(digests: bytes) -> bytes:
    """SHA-256 of the lowercase hex of one or more digests."""
    return hashlib.sha256(digests.hex().encode()).digest()


def leaf(columns: Sequence[Column]) -> Column:
    """SHA-256 over the columns: each ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    texts = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def append_block(leaves: Sequence[bytes], height: int) -> tuple[bytes, list[bytes], list[str]]:
    """Append ``leaves`` one by one to an empty tree and close it at ``height``: its root, and siblings and steps of every leaf.

    Open subtrees form a stack of falling heights.  Closing lifts the lowest open subtree, by hashing it alone, until it meets the next.
    A step is a letter per level, lowest first: L or R where the sibling stands, ``-`` where there is none.
    """
    siblings, steps = [b""] * len(leaves), [""] * len(leaves)
    stack: list[tuple[int, bytes, int, int]] = []  # height, root, first leaf, end

    def extend(start: int, end: int, sibling: bytes, step: str) -> None:
        for i in range(start, end):
            siblings[i] += sibling
            steps[i] += step

    def meet() -> None:
        while len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            level, right, middle, end = stack.pop()
            _, left, start, _ = stack.pop()
            extend(start, middle, right, "R")
            extend(middle, end, left, "L")
            stack.append((level + 1, _hash(left + right), start, end))

    for i, digest in enumerate(leaves):
        stack.append((0, digest, i, i + 1))
        meet()
    while len(stack) > 1 or stack[0][0] < height:
        level, digest, start, end = stack.pop()
        extend(start, end, b"", "-")
        stack.append((level + 1, _hash(digest), start, end))
        meet()
    return stack[0][1], siblings, steps


def fold(digest: bytes, siblings: bytes, steps: str) -> bytes:
    """The root that a leaf's digest leads to by its witness."""
    at = 0
    for step in steps:
        if step == "-":
            digest = _hash(digest)
            continue
        other, at = siblings[at : at + 32], at + 32
        digest = _hash(other + digest if step == "L" else digest + other)
    return digest


@dataclass
class Manifest:
    """Trees by key.  Level 0 holds the leaves, every other level the block roots of the one below:
    ``key, block, pos, digest, root, siblings, steps``; witnesses end at the block's root.  ``sizes`` has ``key, n``."""

    carry: str = ""
    height: int = HEIGHT
    levels: list[DataFrame] = field(default_factory=list)
    sizes: DataFrame | None = None

    def append(self, leaves: DataFrame, order: Sequence[str]) -> None:
        """Append ``key, digest`` and the carried columns; a tree's new leaves follow all earlier ones, among themselves they ascend by ``order``."""
        nodes = numbered(leaves, order, self.sizes)
        added = nodes.groupBy("key").agg(F.max("pos").alias("last"))
        sizes = added.select("key", (F.col("last") + 1).alias("n"))
        if self.sizes is not None:
            sizes = sizes.unionByName(self.sizes).groupBy("key").agg(F.max("n").alias("n"))
        sizes = materialize(sizes)
        before = None if self.sizes is None else self.sizes.withColumnRenamed("n", "before").join(added.select("key"), "key", "left_semi")
        most, level, grown = sizes.agg(F.max("n")).first()[0] or 0, 0, []
        while True:
            old = self.levels[level] if level < len(self.levels) else None
            kept = None
            if old is not None:
                # Blocks that were full stay; the leaves of the others are appended anew, as far as they are final themselves.
                aged = old.join(before, "key", "left").withColumn("full", F.expr(f"shiftright(before, {self.height * (level + 1)})"))
                kept = aged.filter("before IS NULL OR block < full").select(*old.columns)
                again = aged.filter(f"block >= full AND pos < shiftright(before, {self.height * level})")
                nodes = again.select(*nodes.columns).unionByName(nodes)
            counted = sizes.selectExpr("key", f"shiftright(n + {(1 << self.height * level) - 1}, {self.height * level}) AS n")
            built = materialize(self._blocks(nodes, counted, self.carry if level == 0 else ""))
            grown.append(built if kept is None else materialize(kept.unionByName(built)))
            if most <= 1 << self.height * (level + 1):
                break
            level += 1
            # Where the level above is new, the roots of older full blocks are appended to it as well.
            roots = (built if level < len(self.levels) else grown[-1]).filter(f"pos % {1 << self.height} = 0")
            nodes = materialize(roots.select("key", F.col("block").alias("pos"), F.col("root").alias("digest")))
        self.levels, self.sizes = grown, sizes

    def _blocks(self, nodes: DataFrame, counted: DataFrame, carry: str) -> DataFrame:
        """Append each block of ``nodes`` in a task of its own."""
        height, names = self.height, [c.split()[0] for c in carry.split(",") if c]

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("pos")
            n = table["n"][0].as_py()
            # The only block of a tree is as high as the tree; one of several is as high as the others.
            root, siblings, steps = append_block(table["digest"].to_pylist(), height if n > 1 << height else (n - 1).bit_length())
            own = {"key": table["key"], "block": table["block"], "pos": table["pos"], "digest": table["digest"]}
            own |= {"root": pa.array([root] * len(table), pa.binary()), "siblings": pa.array(siblings, pa.binary()), "steps": pa.array(steps)}
            return pa.table(own | {name: table[name] for name in names})

        ends = counted.withColumnRenamed("key", "_key")
        placed = nodes.withColumn("block", F.expr(f"shiftright(pos, {height})"))
        # One row per block learns the size of its tree, then the blocks' rows: no key is frequent in either join.
        blocks = placed.select("key", "block").distinct().join(ends, F.col("key") == F.col("_key")).drop("_key")
        schema = "key string, block long, pos long, digest binary, root binary, siblings binary, steps string"
        return placed.join(blocks, ["key", "block"]).groupBy("key", "block").applyInArrow(run, schema + (f", {carry}" if carry else ""))

    def roots(self) -> DataFrame:
        """``key, root`` of every tree."""
        return self.levels[-1].filter("pos = 0").select("key", "root")

    def witnesses(self, above: DataFrame | None = None) -> DataFrame:
        """Leaves with their carried columns, ``root`` and whole witness.

        ``above`` has ``key, subroot, root, siblings, steps`` of another manifest whose leaves are the roots of this one; witnesses then
        go on to its root.  It joins the highest level, whose keys have one block each, and is handed down block by block.
        """
        top = self.levels[-1]
        if above is not None:
            top = top.drop("root").alias("l").join(above.alias("u"), "key")
            top = top.selectExpr(*[c for c in self.levels[-1].columns if c not in ("root", "siblings", "steps")], "subroot", "root", *EXTENDED)
        for lower in reversed(self.levels[:-1]):
            up = materialize(top.drop("block", "digest").withColumnRenamed("pos", "block"))
            own = [c for c in lower.columns if c not in ("root", "siblings", "steps")]
            shown = [c for c in up.columns if c in ("subroot", "root")]
            top = lower.drop("root").alias("l").join(up.alias("u"), ["key", "block"]).selectExpr(*own, *shown, *EXTENDED)
        return top


# A witness followed by that of the subtree's root.
EXTENDED = ["concat(l.siblings, u.siblings) AS siblings", "concat(l.steps, u.steps) AS steps"]


def numbered(df: DataFrame, order: Sequence[str], sizes: DataFrame | None = None) -> DataFrame:
    """``df`` with ``pos``, from 0 or the tree's size so far, by ``order`` (nulls first) within ``key``; written.

    The table is cut into ranges of (key, order, row), so neither a frequent key nor equal rows meet in one task.
    """
    rows, least = df.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(max(least, -(-rows // RANGE_ROWS)), rows // 1000))
    ranged = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, "key", *order, "_row")
    ranged = materialize(ranged.withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("key", "_part").agg(F.count("*").alias("_n"))
    counts = counts.selectExpr("key", "_part", "sum(_n) OVER (PARTITION BY key ORDER BY _part) - _n AS _before")
    if sizes is not None:
        counts = counts.join(sizes, "key", "left").selectExpr("key", "_part", "_before + coalesce(n, 0) AS _before")
    local = f"row_number() OVER (PARTITION BY key, _part ORDER BY {', '.join(order)}, _row)"
    placed = ranged.withColumn("_local", F.expr(local)).join(counts, ["key", "_part"])
    return materialize(placed.selectExpr(*df.columns, "_before + _local - 1 AS pos"))


def tree_key(lang: Column) -> Column:
    """Keys of langs: a missing one sorts first and differs from an empty one; the others keep their bytewise order."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def leaves_of(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """``doc_id, key, digest, shown`` of every row, written; ``shown`` is the leaf with another ``n_chars`` where ``altered`` isn't null."""
    own = [F.col(c) for c in FIELDS]
    shown = F.when(altered.isNotNull(), leaf([*own[:3], altered, own[4]])) if altered is not None else F.lit(None).cast("binary")
    return materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree_key(F.col("lang")).alias("key"), leaf(own).alias("digest"), shown.alias("shown"))
    )


def proven(leaves: Sequence[DataFrame], height: int = HEIGHT) -> DataFrame:
    """``doc_id, digest, shown, subroot, root, siblings, steps`` of all ``leaves_of`` the batches, which are appended one after the other.

    Leaves ascend by doc_id, missing ones first; rows that agree in doc_id follow by their hash, and equal rows stand in any order.
    A batch's doc_ids come after those of the batches before it.  No rows give no rows.
    """
    trees = Manifest("doc_id long, shown binary", height)
    for batch in leaves:
        trees.append(batch, ["doc_id", "digest"])
    forest = Manifest("tree string", height)
    forest.append(trees.roots().select(F.lit(TOP).alias("key"), F.col("key").alias("tree"), F.col("root").alias("digest")), ["tree"])
    above = forest.witnesses().select(F.col("tree").alias("key"), F.col("digest").alias("subroot"), "root", "siblings", "steps")
    return trees.witnesses(materialize(above))


def verify(df: DataFrame) -> DataFrame:
    """Add ``proof``, the hash of a witness, and ``folded``, the root to which it leads from ``shown`` (null: ``digest``)."""
    names = ["doc_id", "digest", "subroot", "root"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, shown, siblings, steps = (batch.column(c).to_pylist() for c in ("digest", "shown", "siblings", "steps"))
            proofs = [_hash(s) for s in siblings]
            folded = [fold(d if other is None else other, s, way) for d, other, s, way in zip(digests, shown, siblings, steps)]
            columns = [batch.column(c) for c in names] + [pa.array(proofs, pa.binary()), pa.array(folded, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "proof", "folded"])

    return map_arrow(df, run, "doc_id long, digest binary, subroot binary, root binary, proof binary, folded binary")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Witnesses of all documents, replayed on tampered rows; see :func:`proven` for nulls, ties and repeated rows."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1)
    checked = verify(proven([leaves_of(read(spark, sf_dir, "documents"), tampered)]))
    text = lambda c: F.lower(F.hex(c))
    return checked.select(
        "doc_id",
        text("digest").alias("leaf"),
        text("subroot").alias("subroot"),
        text("root").alias("root"),
        text("proof").alias("proof_sha256"),
        text("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


# DuckDB has no CRC-32; its rows come from the eight bit steps over each byte of the decimal doc_id.
ORACLE = r"""
WITH RECURSIVE bytes AS (
  SELECT i, list_reduce(range(0, 9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS entry
  FROM range(256) t(i)
), crc AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT crc.doc_id, s, k + 1, xor(c >> 8, b.entry) FROM crc JOIN bytes b ON b.i = xor(c & 255, ascii(s[k + 1])) WHERE k < length(s)
), chosen AS (
  SELECT doc_id FROM crc WHERE k = length(s) AND xor(c, 4294967295) % 7 = 0
), fields AS (
  SELECT doc_id, lang, n_chars IS NOT NULL AND doc_id IN (SELECT doc_id FROM chosen) AS altered,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS size, strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) AS size_up,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, sha256(head || size || tail) AS leaf, CASE WHEN altered THEN sha256(head || size_up || tail) ELSE sha256(head || size || tail) END AS shown FROM fields)
), trees AS (
  SELECT lang, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM leaves GROUP BY lang
), nodes AS (
  SELECT t.tree, 0 AS level, l.pos, l.n, l.leaf AS hash FROM leaves l JOIN trees t ON l.lang IS NOT DISTINCT FROM t.lang
  UNION ALL
  SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 2, n
), subroots AS (
  SELECT tree, level AS height, hash AS subroot FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM subroots) AS n, subroot AS hash FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2, n
), places AS (
  SELECT row_number() OVER () AS id, l.doc_id, l.leaf, l.shown, l.pos, s.tree, s.height, s.subroot
  FROM leaves l JOIN trees t ON l.lang IS NOT DISTINCT FROM t.lang JOIN subroots s ON s.tree = t.tree
), ways AS (
  SELECT p.id, n.level AS step, n.hash AS own, o.hash AS other, n.pos & 1 = 1 AS on_left
  FROM places p JOIN nodes n ON n.tree = p.tree AND n.pos = p.pos >> n.level AND n.level < p.height
  LEFT JOIN nodes o ON o.tree = n.tree AND o.level = n.level AND o.pos = xor(n.pos, 1)
  UNION ALL
  SELECT p.id, p.height + n.level, n.hash, o.hash, n.pos & 1 = 1
  FROM places p JOIN tops n ON n.pos = p.tree >> n.level AND n.n > 1 LEFT JOIN tops o ON o.level = n.level AND o.pos = xor(n.pos, 1)
), folded AS (
  SELECT id, 0 AS step, shown AS hash FROM places
  UNION ALL
  SELECT f.id, f.step + 1, sha256(CASE WHEN w.other IS NULL THEN f.hash WHEN w.on_left THEN w.other || f.hash ELSE f.hash || w.other END)
  FROM folded f JOIN ways w ON w.id = f.id AND w.step = f.step
), ends AS (
  SELECT id, arg_max(hash, step) AS folded_root FROM folded GROUP BY id
), proofs AS (
  SELECT id, sha256(coalesce(string_agg(other, '' ORDER BY step), '')) AS proof_sha256 FROM ways GROUP BY id
)
SELECT p.doc_id, p.leaf, p.subroot, r.hash AS root, coalesce(f.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = r.hash AS verified
FROM places p JOIN ends e ON e.id = p.id LEFT JOIN proofs f ON f.id = p.id CROSS JOIN (SELECT hash FROM tops WHERE n = 1) r
"""
