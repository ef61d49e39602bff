"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed letter trigrams.  Each language has several centroids from spherical
k-means over its labelled rows; a text takes the language of the centroid with the highest cosine and is rejected when that centroid is
too far.  Document frequencies count every learning row; clustering uses at most ``FIT_ROWS`` rows a language,
chosen by a hash of doc_id (all rows of a language that has no more).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, read, within
from tidemark.session import materialize

BUCKETS = 8192
FIT_ROWS = 500
CLUSTERS = 3
ROUNDS = 12
# A text is rejected when its cosine is below this share of the lowest percent of its language's learning rows.
REJECT_SHARE = 0.2
# Fewer distinct trigrams than this are too little evidence for a distance, and such texts are not rejected.
MIN_TRIGRAMS = 10
MAX_LANGUAGES = 2000
CHUNK_CHARS = 1 << 20
BATCH = 256
UNKNOWN = "und"


def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def trigram_counts(text: str, letters: np.ndarray) -> np.ndarray:
    """Counts of hashed trigrams of lower-cased letters; every run of other characters is one space."""
    counts = np.zeros(BUCKETS, np.float32)
    tail = np.array([32], np.uint32)
    for at in range(0, len(text), CHUNK_CHARS):
        chunk = text[at : at + CHUNK_CHARS].lower() + (" " if at + CHUNK_CHARS >= len(text) else "")
        points = np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.concatenate((tail, np.where(letters[points], points, np.uint32(32))))
        points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]
        mixed = (points[:-2] * np.uint32(0x9E3779B1) + points[1:-1]) * np.uint32(0x85EBCA6B) + points[2:]
        counts += np.bincount((mixed * np.uint32(0xC2B2AE35)) >> np.uint32(19), minlength=BUCKETS)
        tail = points[-2:]
    return counts


def vectors(texts: list[str | None], idf: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """A row of unit length for each text; zero when a text has no letters."""
    out = np.stack([trigram_counts(t or "", letters) for t in texts])
    out = np.log1p(out) * idf
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


@dataclass
class Model:
    """Centroids (rows of unit length), the language of each and its lowest accepted cosine."""

    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray
    lowest: np.ndarray


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _document_frequencies(learning: DataFrame) -> np.ndarray:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, seen, rows = _letters(), np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                seen += trigram_counts(text.as_py(), letters) > 0
                rows += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BUCKETS + 1)), pa.array(np.append(seen, rows))], names=["bucket", "df"]
        )

    found = map_arrow(learning.select("text"), run, "bucket long, df long").groupBy("bucket").agg(F.sum("df"))
    out = np.zeros(BUCKETS + 1)
    for bucket, df in found.collect():  # BUCKETS + 1 numbers
        out[bucket] = df
    return out


def fit(
    docs: DataFrame, fit_rows: int = FIT_ROWS, clusters: int = CLUSTERS, reject_share: float = REJECT_SHARE
) -> Model:
    """Learn from the rows of ``docs(doc_id, text, lang)`` that have a language, a doc_id and letters."""
    learning = docs.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text RLIKE '[\\\\p{L}]'").select(
        "doc_id", "text", "lang"
    )
    df = _document_frequencies(learning)
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)
    # A share of each language by hash leaves few more rows than wanted, so the exact cut sorts a bounded set.
    sizes = learning.select("lang").groupBy("lang").count()
    share = sizes.select(F.col("lang").alias("_lang"), F.least(F.lit(1.0), 1.5 * fit_rows / F.col("count")).alias("_share"))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    sample = (
        learning.join(within(materialize(share)), F.col("lang") == F.col("_lang"))
        .filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * F.col("_share"))
        .withColumn("_rank", F.row_number().over(by_hash))
        .filter(F.col("_rank") <= fit_rows)
        .select("text", "lang", "_rank")
    )

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_rank")
        x = vectors(rows["text"].tolist(), idf, _letters())
        k = min(clusters, len(x))
        # Farthest-first start, then spherical k-means.
        start = [0]
        while len(start) < k:
            start.append(int((x @ x[start].T).max(axis=1).argmin()))
        centers = x[start]
        for _ in range(ROUNDS):
            nearest = (x @ centers.T).argmax(axis=1)
            centers = np.stack([x[nearest == j].sum(axis=0) if (nearest == j).any() else centers[j] for j in range(k)])
            centers /= np.linalg.norm(centers, axis=1, keepdims=True)
        lowest = float(np.quantile((x @ centers.T).max(axis=1), 0.01)) * reject_share
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "lowest": lowest, "centroid": [c.tolist() for c in centers]})

    fitted = sample.groupBy("lang").applyInPandas(cluster, "lang string, lowest double, centroid array<float>")
    found = fitted.limit(MAX_LANGUAGES * clusters + 1).collect()
    if len(found) > MAX_LANGUAGES * clusters:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found.sort(key=lambda r: (r["lang"], r["centroid"]))
    return Model(
        idf,
        [r["lang"] for r in found],
        np.array([r["centroid"] for r in found], np.float32).reshape(len(found), BUCKETS),
        np.array([r["lowest"] for r in found]),
    )


def identify(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of ``docs`` and ``lang_pred, score, rejected`` for every row; ``docs`` needs ``text``.

    ``lang_pred`` is the nearest centroid's language (ties: the first by name), or ``und`` for texts without a
    letter, null texts and a model without languages, which are rejected with score 0.  ``score`` is the cosine.  A
    text of at least ``MIN_TRIGRAMS`` distinct trigrams that is too far from every centroid keeps the nearest
    language and is marked as rejected.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                x = vectors(part.column(0).to_pylist(), model.idf, letters)
                enough = (x > 0).sum(axis=1) >= MIN_TRIGRAMS
                known = x.any(axis=1) & bool(model.langs)
                cosines = x @ model.centroids.T if model.langs else np.zeros((len(x), 1), np.float32)
                best = cosines.argmax(axis=1)
                score = np.where(known, np.clip(cosines.max(axis=1), 0, 1), 0).astype(float)
                langs = [model.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                rejected = ~known | enough & (score < (model.lowest[best] if model.langs else 1))
                found = [pa.array(langs, pa.string()), pa.array(score.round(6)), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], *found], names=[*keep, "lang_pred", "score", "rejected"]
                )

    kinds = dict(docs.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "lang_pred string, score double, rejected boolean"])
    return map_arrow(docs.select(F.col("text").cast("string").alias("_text"), *keep), run, schema)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
