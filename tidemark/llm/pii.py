"""Personal data: direct identifiers by pattern, indirect ones by information content.

Emails, addresses, card and phone numbers are found by fixed patterns.  The corpus then tells which ordinary terms give these
entities away: a term that stands near an entity in several different contexts and hardly anywhere else discloses it.  With n_te
texts that hold the term near the entity, n_t texts with the term, n_e texts with the entity and N texts, copies of one text counted once, the disclosure is
n_te / n_t, the chance of the entity once the term is known, and the gain is log2(n_te * N / (n_t * n_e)) bits.  Terms
above both thresholds are generalised everywhere, those that nearly name the entity are removed.

All text work is done by built-in functions.  Positions are running sums over the pieces between matches, so long texts with many
matches stay linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read, within
from tidemark.session import materialize

# Patterns of the direct identifiers.  Matching starts at the beginning of a run of characters or where the last match ended;
# possessive parts give the same matches as greedy ones here and keep matching linear.
KINDS = {
    "email": (
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "contains(text, '@')",
        "true",
    ),
    "ip": (
        r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
        "text RLIKE '[0-9][.][0-9]'",
        r"forall(split(found, '[.]'), p -> CAST(p AS DOUBLE) <= 255)",
    ),
    "card": (
        r"(?:\G|(?<![0-9]))[0-9](?:[ -]?+[0-9])++",
        "text RLIKE '[0-9]'",
        "length(digits) BETWEEN 13 AND 19 AND aggregate(sequence(1, length(digits)), 0, (s, i) -> s"
        " + CAST(substring(digits, -i, 1) AS INT) * (2 - i % 2)"
        " - IF(CAST(substring(digits, -i, 1) AS INT) * (2 - i % 2) > 9, 9, 0)) % 10 = 0",
    ),
    "phone": (
        r"\+[0-9][ ().0-9-]+[0-9]",
        "contains(text, '+')",
        "length(digits) BETWEEN 9 AND 15",
    ),
}
ANY = "text RLIKE '[0-9@]'"
TERM = "term"
ORDER = [*KINDS, TERM]
WORD = r"[\p{L}\p{N}_]+"
NOT_WORD = r"[^\p{L}\p{N}_]+"
# Code points on either side of an entity that count as its context.
CONTEXT = 100
MIN_CONTEXTS = 2
GENERALISE, REMOVE, MIN_BITS = 0.5, 0.9, 3.0
KEY = ["doc_id", "h"]


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, h, text``: rows that agree in doc_id and text agree in everything that follows."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))


def _located(texts: DataFrame, pattern: str) -> DataFrame:
    """``doc_id, h, found, start, end, before, after``: matches of the pattern with their neighbouring pieces."""
    cut = texts.select(
        *KEY,
        F.posexplode(
            F.arrays_zip(
                F.split("text", pattern, -1).alias("piece"),
                F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("found"),
            )
        ).alias("pos", "z"),
    ).select(*KEY, "pos", "z.piece", F.coalesce("z.found", F.lit("")).alias("found"))
    order = "PARTITION BY doc_id, h ORDER BY pos"
    return cut.selectExpr(
        *KEY, "found", "piece AS before", f"lead(piece) OVER ({order}) AS after",
        f"sum(char_length(piece) + char_length(found)) OVER ({order} ROWS UNBOUNDED PRECEDING) AS end",
    ).filter("found <> ''").selectExpr("*", "end - char_length(found) AS start")


def mentions(texts: DataFrame) -> DataFrame:
    """``doc_id, h, kind, start, end, value, context`` of the direct identifiers; ``texts`` has unique keys."""
    out = None
    for kind, (pattern, likely, valid) in KINDS.items():
        found = (
            _located(texts.filter(likely), pattern)
            .withColumn("digits", F.regexp_replace("found", "[^0-9]", ""))
            .filter(valid)
            .select(
                *KEY, F.lit(kind).alias("kind"), "start", "end",
                (F.lower("found") if kind in ("email", "ip") else F.col("digits")).alias("value"),
                F.concat_ws(" ", F.right("before", F.lit(CONTEXT)), F.left("after", F.lit(CONTEXT))).alias("context"),
            )
        )
        out = found if out is None else out.unionByName(found)
    return out


def disclosing_terms(
    docs: DataFrame, found: DataFrame, min_contexts: int = MIN_CONTEXTS, generalise: float = GENERALISE,
    remove: float = REMOVE, min_bits: float = MIN_BITS,
) -> DataFrame:
    """``term, action, disclosure, bits``: terms that reveal some entity, over all of ``docs(doc_id, h, text)``.

    A text counts once however often it is copied, and so does a context, of which a term needs ``min_contexts``.  Every word can be a term.
    """
    near = found.select(
        "kind", "value", "h", F.xxhash64("context").alias("c"), F.explode(F.array_distinct(F.split(F.lower("context"), NOT_WORD))).alias("term")
    ).filter("term <> ''")
    joint = (
        near.groupBy("kind", "value", "term")
        .agg(F.count_distinct("h").alias("n_te"), F.count_distinct("c").alias("contexts"))
        .filter(F.col("contexts") >= min_contexts)
        .drop("contexts")
    )
    own = found.groupBy("kind", "value").agg(F.count_distinct("h").alias("n_e"))
    joint = materialize(joint.join(own, ["kind", "value"]))
    candidates = within(materialize(joint.select("term").distinct()))
    # Copies meet once as texts; after that a term's texts are counted by sums, which combine before their shuffle.
    texts = docs.select("h", "text").dropDuplicates(["h"])
    words = texts.select(F.explode(F.array_distinct(F.split(F.lower("text"), NOT_WORD))).alias("term"))
    spread = words.join(candidates, "term").groupBy("term").agg(F.count("*").alias("n_t"))
    scored = joint.join(spread, "term").select(
        "term",
        F.least(F.lit(1.0), F.col("n_te") / F.col("n_t")).alias("disclosure"),
        F.log2(F.col("n_te") * F.lit(docs.select("h").distinct().count()) / (F.col("n_t") * F.col("n_e"))).alias("bits"),
    )
    return (
        scored.filter((F.col("disclosure") >= generalise) & (F.col("bits") >= min_bits))
        .groupBy("term")
        .agg(F.max("disclosure").alias("disclosure"), F.max("bits").alias("bits"))
        .withColumn("action", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise"))
    )


def find_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keyed ``docs`` and the spans ``doc_id, h, kind, start, end, action`` of the direct and indirect identifiers.

    Offsets are code points, end exclusive.  A term inside a direct identifier is not reported again.
    """
    keyed = _keyed(docs)
    suspects = materialize(keyed.filter(ANY).dropDuplicates(KEY))
    found = materialize(mentions(suspects))
    terms = materialize(disclosing_terms(keyed, found))
    few = within(terms.select("term", "action"))
    holding = (
        keyed.select(*KEY, F.explode(F.array_distinct(F.split(F.lower("text"), NOT_WORD))).alias("term"))
        .join(within(terms.select("term")), "term")
        .select(*KEY)
        .distinct()
    )
    holding = materialize(holding)
    # Rows without doc_id have their terms like any other.
    same = lambda left, right: left["doc_id"].eqNullSafe(right["_id"]) & (left["h"] == right["_h"])
    holding = within(holding).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    texts = keyed.join(holding, same(keyed, holding), "left_semi").dropDuplicates(KEY)
    places = _located(texts, WORD).withColumn("term", F.lower("found")).join(few, "term").select(*KEY, "start", "end", "action")
    direct = found.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_list(F.struct("start", "end")).alias("direct"))
    free = places.join(direct, same(places, direct), "left").drop("_id", "_h").filter(
        "direct IS NULL OR NOT exists(direct, d -> d.start < end AND start < d.end)"
    )
    spans = found.select(*KEY, "kind", "start", "end", F.lit("remove").alias("action")).unionByName(
        free.select(*KEY, F.lit(TERM).alias("kind"), "start", "end", "action")
    )
    return keyed, materialize(spans)


def _gathered(spans: DataFrame) -> DataFrame:
    """Per key: spans sorted by kind as listed and start."""
    rank = F.array_position(F.array(*[F.lit(k) for k in ORDER]), F.col("kind"))
    return spans.groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind", "action"))).alias("spans")
    )


def _joined(docs: DataFrame, gathered: DataFrame) -> DataFrame:
    right = gathered.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "spans")
    return docs.join(right, docs["doc_id"].eqNullSafe(right["_id"]) & (docs["h"] == right["_h"]), "left").drop("_id", "_h")


def sanitize(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with direct identifiers as ``[KIND]``, generalised terms as ``[TERM]`` and removed terms cut out.

    Overlapping spans are one, named after the first.  Null text is empty.
    """
    keyed, spans = find_spans(docs)
    # Spans sorted by start; each begins where the furthest end so far allows.
    order = "PARTITION BY doc_id, h ORDER BY start, end DESC, kind"
    merged = spans.selectExpr(
        *KEY, "kind", "start", "end", "action",
        f"coalesce(max(end) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached",
    )
    label = "IF(kind = 'term' AND action = 'remove', '', concat('[', upper(kind), ']'))"
    parts = merged.selectExpr(
        *KEY, "start", "greatest(end, reached) AS stop", "reached", f"IF(start >= reached, {label}, '') AS label"
    )
    gathered = parts.groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.struct("start", "stop", "reached", "label"))).alias("spans")
    )
    clean = F.expr(
        "concat(array_join(transform(spans, s -> concat("
        "  substring(text, CAST(s.reached AS INT) + 1, CAST(greatest(s.start - s.reached, 0) AS INT)), s.label)), ''),"
        " substring(text, CAST(array_max(spans.stop) AS INT) + 1))"
    )
    return _joined(keyed, gathered).select("doc_id", F.coalesce(clean, "text").alias("text"))


def _written(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document.  Null texts are empty and an empty table gives no rows; repeated rows are repeated in the result."""
    keyed, spans = find_spans(read(spark, sf_dir, "documents"))
    every = _joined(keyed.select(*KEY), _gathered(spans)).withColumn("spans", F.coalesce("spans", F.expr("array()").cast(
        "array<struct<rank:bigint,start:bigint,end:bigint,kind:string,action:string>>"
    )))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return every.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_written(F.filter("spans", lambda s: s["kind"] != TERM)), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
    )
