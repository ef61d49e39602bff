"""Merkle fingerprints of documents.

The tree of a text: root <- sections (cut at empty lines) <- paragraphs (lines) <- leaves, runs of at most four words that end with
a sentence or line.  A leaf is the SHA-256 of its text, every other node that of its children's hashes.  Equal roots mean equal
texts.  Branches are aligned by hash and not by place, so an inserted line is one edit; the share of common leaves is the likeness
of two trees.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read

# Leaves cover a paragraph without gaps; possessive parts keep matching linear.
LEAF = r"(?:[^ \t\n\x0B\f\r.!?]++[ \t\x0B\f\r]++){0,3}+[^ \t\n\x0B\f\r.!?]*+[.!?]*+[ \t\n\x0B\f\r]*+"
# Texts of so many bytes share a bucket of neighbours on average; there are at most MAX_BUCKETS of them.
BUCKET_BYTES = 4 << 20
MAX_BUCKETS = 1 << 15
# Missing doc_id comes last in descending order.
LAST_ID = -(1 << 63)


def leaves(text: Column) -> Column:
    """Leaf hashes by section and paragraph."""
    hashed = lambda p: F.transform(F.filter(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda t: t != F.lit("")), lambda t: F.sha2(t, 256))
    return F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), hashed))


def _up(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


def fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the tree of the text column: ``name_root, name_sections, name_paragraphs`` and ``name_leaves`` (distinct, 64 bits each)."""
    down = df.withColumn(f"{name}_tree", leaves(F.coalesce(F.col(text), F.lit(""))))
    nodes = down.withColumns(
        {
            f"{name}_by_section": F.transform(f"{name}_tree", lambda s: F.transform(s, _up)),
            f"{name}_leaves": F.array_distinct(F.transform(F.flatten(F.flatten(f"{name}_tree")), lambda t: F.xxhash64(t))),
        }
    ).drop(f"{name}_tree")
    nodes = nodes.withColumns(
        {f"{name}_sections": F.transform(f"{name}_by_section", _up), f"{name}_paragraphs": F.flatten(f"{name}_by_section")}
    ).drop(f"{name}_by_section")
    return nodes.withColumn(f"{name}_root", _up(F.col(f"{name}_sections")))


def likeness(a: str, b: str) -> Column:
    """Dice share of common leaves of two trees; one for equal roots."""
    common = F.size(F.array_intersect(f"{a}_leaves", f"{b}_leaves"))
    return F.when(F.col(f"{a}_root") == F.col(f"{b}_root"), F.lit(1.0)).otherwise(
        F.coalesce(F.try_divide(2.0 * common, F.size(f"{a}_leaves") + F.size(f"{b}_leaves")), F.lit(0.0))
    )


def differing(a: str, b: str, level: str = "paragraphs") -> Column:
    """Distinct hashes of the nodes of ``a`` that are nowhere in ``b``, in order; ``level`` is sections, paragraphs or leaves."""
    return F.array_except(f"{a}_{level}", f"{b}_{level}")


def first_difference(a: str, b: str) -> Column:
    """Position (from 0) of the first paragraph of ``a`` that is nowhere in ``b``; null if there is none."""
    return F.array_position(F.col(f"{a}_paragraphs"), F.get(differing(a, b), F.lit(0))) - 1


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, next_text``: the text that follows in descending doc_id; after the last comes the first.

    Rows with equal doc_id follow each other by text; rows without doc_id come last.  Texts move once: quantiles of
    doc_id cut the table into buckets of consecutive documents, and each bucket also gets a copy of the
    first document of the bucket after it.
    """
    source = docs.select(
        "doc_id",
        F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    size = source.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = min(MAX_BUCKETS, max(1, math.ceil(size / BUCKET_BYTES)))
    share = [F.lit((i + 1) / n) for i in range(n - 1)]
    borders = sorted(set(source.agg(F.percentile_approx("id", F.array(*share), max(10_000, 20 * n))).first()[0] or [])) if share else []
    # Number of borders below the id, by binary search in a constant array of bounded length.
    steps = max(1, len(borders)).bit_length()
    table = F.array(*[F.lit(b) for b in borders]).cast("array<bigint>")
    bucket = F.aggregate(
        F.array(*[F.lit(1 << s) for s in reversed(range(steps))]),
        F.lit(0),
        lambda low, step: F.when(
            (low + step <= len(borders)) & (F.get(table, low + step - 1) < F.col("id")), low + step
        ).otherwise(low),
    )
    placed = source.withColumn("bucket", bucket).withColumn("guest", F.lit(False))
    # One number per bucket reaches the driver.
    tops = [(r[0], r[1]) for r in placed.groupBy("bucket").agg(F.max("id")).orderBy("bucket").collect()]
    guests = [(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)]
    if not guests:
        return source.select("doc_id", "text", F.col("text").alias("next_text"))
    target = docs.sparkSession.createDataFrame(guests, "id long, bucket int")
    first = source.join(F.broadcast(target), "id").groupBy("id", "bucket").agg(F.min("text").alias("text"))
    both = placed.unionByName(
        first.select(F.lit(None).cast("long").alias("doc_id"), "id", "text", "bucket", F.lit(True).alias("guest"))
    )
    follows = "lead(text) OVER (PARTITION BY bucket ORDER BY guest, id DESC, text) AS next_text"
    return both.selectExpr("doc_id", "text", "guest", follows).filter("NOT guest").drop("guest")


def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text.  Null texts are empty; an empty table gives no rows."""
    pairs = with_next(read(spark, sf_dir, "documents")).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = pairs.withColumn(
        "edited",
        F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half)),
    )
    for text, name in (("text", "own"), ("edited", "edited"), ("next_text", "next")):
        edited = fingerprint(edited, text, name)
    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("own_root").alias("fingerprint"),
        F.col("edited_root").alias("edited_fingerprint"),
        F.round(likeness("own", "edited"), 9).alias("near_edited"),
        F.round(likeness("own", "next"), 9).alias("near_next"),
        F.size("own_paragraphs").cast("long").alias("n_paragraphs"),
        first_difference("own", "edited").cast("long").alias("first_edit"),
        F.size(differing("own", "edited")).cast("long").alias("n_edits"),
        F.size(differing("edited", "own")).cast("long").alias("n_inserted"),
        F.size(differing("own", "edited", "sections")).cast("long").alias("n_sections_changed"),
    )


_LEAF_SQL = LEAF.replace("++", "+").replace("}+", "}").replace("*+", "*")


def _leaves_sql(column: str) -> str:
    return (
        f"list_transform(string_split({column}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: "
        f"list_transform(list_filter(regexp_extract_all(p, '{_LEAF_SQL}'), lambda t: t <> ''), lambda t: sha256(t))))"
    )


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM documents
), nexts AS (
  SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC, text), first_value(text) OVER (ORDER BY doc_id DESC, text)) AS next_text
  FROM docs
), edited AS (
  SELECT *, left(text, n_chars - n_chars // 2) || left(next_text, n_chars // 2) AS edited FROM nexts
), leaves AS (
  SELECT *, @own AS own_tree, @edited AS edited_tree, @next AS next_tree FROM edited
), paragraphs AS (
  SELECT *, list_transform(own_tree, lambda s: list_transform(s, lambda p: sha256(array_to_string(p, '')))) AS own_by,
    list_transform(edited_tree, lambda s: list_transform(s, lambda p: sha256(array_to_string(p, '')))) AS edited_by FROM leaves
), sections AS (
  SELECT *, list_transform(own_by, lambda s: sha256(array_to_string(s, ''))) AS own_s,
    list_transform(edited_by, lambda s: sha256(array_to_string(s, ''))) AS edited_s,
    flatten(own_by) AS own_p, flatten(edited_by) AS edited_p, list_distinct(flatten(flatten(own_tree))) AS own_t,
    list_distinct(flatten(flatten(edited_tree))) AS edited_t, list_distinct(flatten(flatten(next_tree))) AS next_t
  FROM paragraphs
), edits AS (
  SELECT *, list_filter(range(1, len(own_p) + 1), lambda i: NOT list_contains(edited_p, own_p[i])) AS changed FROM sections
)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, sha256(array_to_string(own_s, '')) AS fingerprint,
  sha256(array_to_string(edited_s, '')) AS edited_fingerprint,
  round(CASE WHEN text = edited THEN 1.0::DOUBLE WHEN len(own_t) + len(edited_t) = 0 THEN 0.0::DOUBLE
    ELSE 2.0::DOUBLE * len(list_intersect(own_t, edited_t)) / (len(own_t) + len(edited_t)) END, 9) AS near_edited,
  round(CASE WHEN text = next_text THEN 1.0::DOUBLE WHEN len(own_t) + len(next_t) = 0 THEN 0.0::DOUBLE
    ELSE 2.0::DOUBLE * len(list_intersect(own_t, next_t)) / (len(own_t) + len(next_t)) END, 9) AS near_next,
  len(own_p) AS n_paragraphs, list_min(changed) - 1 AS first_edit, len(list_distinct(list_transform(changed, lambda i: own_p[i]))) AS n_edits,
  len(list_distinct(list_filter(edited_p, lambda p: NOT list_contains(own_p, p)))) AS n_inserted,
  len(list_distinct(list_filter(own_s, lambda s: NOT list_contains(edited_s, s)))) AS n_sections_changed
FROM edits
"""
for _name, _column in (("own", "text"), ("edited", "edited"), ("next", "next_text")):
    ORACLE = ORACLE.replace(f"@{_name} ", f"{_leaves_sql(_column)} ")
