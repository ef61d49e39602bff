"""Hierarchical residual packing of tokenised documents.

Documents are tokenised where they lie; only token counts and checksums of their pieces move on.  A
document above the sequence length is cut so that all pieces but the first are full, which leaves one item per document to pack.  Every task
packs its items best-fit (longest first).  Nearly full bins are emitted; the others become items of the next round, which
merges several tasks' rests, until one round holds them all or rounds stop saving bins.  No task takes more than
``CHUNK`` items at once, however many there are.
"""

from __future__ import annotations

import base64
import json
import re
import sys
import types
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, read
from tidemark.session import materialize

SEQUENCE = 1024
END_ID = 2
NEARLY_FULL = 0.99
FAN_IN = 8
CHUNK = 100_000
VOCABULARY = "byte_bpe_50k.tiktoken"
# The same vocabulary for the tokenizers library.
LIBRARY = "byte_bpe_50k.json"
# Words whose ids a worker remembers, of at most so many characters: some 30 MB.
WORDS = 200_000
LONGEST = 64
# Longer runs of white space are too deep for the rank file's encoder.
SPACES = re.compile(r"\s{10000}")

# The tokenizer's pattern for the characters below; texts with any other character take the general way.
SIMPLE = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
OTHER = re.compile("[^\t-\r -~¡-±´-¸º»¿-ɏ‐-‧€]")


class WordIds(dict):
    """Little-endian 32-bit ids of the tokenizer's words; forgets everything when it is full."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(word), "<u4").tobytes()
        if len(word) <= LONGEST:
            if len(self) >= WORDS:
                self.clear()
            self[word] = ids
        return ids


def encoder(vocabulary: str = VOCABULARY, library: str = LIBRARY) -> Callable[[str], bytes]:
    """Text to ids as bytes: those of the tokenizers library, without added special tokens.

    The vocabulary's rank file gives the same ids several times faster.  Texts that hold a special token, which the library turns into its
    id, and texts with very long runs of white space go through the library itself.
    """
    # Held in a module of its own, so that a worker keeps its words from one task to the next.
    kept = sys.modules.setdefault("_tidemark_word_ids", types.ModuleType("_tidemark_word_ids"))
    if not hasattr(kept, vocabulary):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as file:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
        whole = tiktoken.Encoding(
            vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        with open(public_tokenizers.path(library), encoding="utf-8") as file:
            special = [token["content"] for token in json.load(file)["added_tokens"]]
        setattr(kept, vocabulary, (whole, WordIds(whole), special))
    whole, words, special = getattr(kept, vocabulary)

    def encode(text: str) -> bytes:
        if any(token in text for token in special) or (len(text) >= 10_000 and SPACES.search(text)):
            if not hasattr(kept, library):
                import public_tokenizers
                from tokenizers import Tokenizer

                setattr(kept, library, Tokenizer.from_file(public_tokenizers.path(library)))
            return np.array(getattr(kept, library).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if OTHER.search(text):
            return np.array(whole(text), "<u4").tobytes()
        return b"".join(map(words.__getitem__, SIMPLE.findall(text)))

    return encode


ITEM = "doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint"
ITEM_TYPE = [
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())
]
END_BYTES = np.array([END_ID], "<u4").tobytes()


def cut(ids: bytes, size: int = SEQUENCE) -> list[tuple[int, int, int]]:
    """``start, length, crc32`` of each piece; only the first may be shorter than ``size``."""
    n = len(ids) // 4
    ends = range(n % size or size, n + 1, size)
    starts = [0, *ends][: len(ends)]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(starts, ends, strict=True)]


def pieces(docs: DataFrame, size: int = SEQUENCE, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: every document's ids and the end id, cut into pieces."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + END_BYTES
                rows += [(doc, i, *piece) for i, piece in enumerate(cut(ids, size))]
            columns = list(zip(*rows, strict=True)) or [[] for _ in ITEM_TYPE]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, (_, t) in zip(columns, ITEM_TYPE, strict=True)], names=[n for n, _ in ITEM_TYPE]
            )

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, ITEM.replace(":", ""))


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item positions: longest first, each into the open bin that it leaves fullest."""
    bins: list[list[int]] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: a bin with room r is open
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = stacks[room].pop()
            if not stacks[room]:
                open_rooms &= ~(1 << room)
            bins[at].append(i)
        else:
            room, at = capacity, len(bins)
            bins.append([i])
        if room > size:
            stacks[room - size].append(at)
            open_rooms |= 1 << (room - size)
    return bins


def _merge(items: pa.Array, fills: np.ndarray, capacity: int, full: int) -> pa.RecordBatch:
    """Pack bins (lists of items) into bins; offsets within a bin are gapless."""
    bins = best_fit(fills, capacity)
    order = pa.array([i for b in bins for i in b], pa.int64())
    taken = items.take(order)
    counts = np.diff(taken.offsets.to_numpy())
    owner = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    per_bin = np.bincount(owner, counts, len(bins)).astype(np.int64)
    flat = taken.flatten()
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per_bin))), pa.int32()), flat)
    fill = np.bincount(owner, fills[order.to_numpy()], len(bins)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(fill), pa.array(fill >= full), lists], names=["fill", "done", "items"])


BIN = f"fill bigint, done boolean, items array<struct<{ITEM}>>"


def _round(capacity: int, full: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                held.append(part := batch.slice(at, CHUNK))
                rows += part.num_rows
                if rows >= CHUNK:
                    yield _packed(held, capacity, full)
                    held, rows = [], 0
        if rows:
            yield _packed(held, capacity, full)

    return run


def _packed(held: list[pa.RecordBatch], capacity: int, full: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).combine_chunks()
    items = table.column("items").combine_chunks()
    items = items.chunk(0) if isinstance(items, pa.ChunkedArray) else items
    return _merge(items, table.column("fill").to_numpy(), capacity, full)


def pack(items: DataFrame, capacity: int = SEQUENCE, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """Add ``sequence_id, offset`` to ``items`` of the columns of :func:`pieces`; each length is at most ``capacity``.

    Items of full length are sequences at once.  Repeated rows are items of their own.  An empty table gives no rows.
    """
    spark = items.sparkSession
    full = int(capacity * nearly_full)
    bins = items.select(
        F.col("length").alias("fill"),
        (F.col("length") >= capacity).alias("done"),
        F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32")).alias("items"),
    )
    finished = [bins.filter("done")]
    rest = bins.filter("NOT done")
    # The scan's own partitions make the first round; later rounds merge FAN_IN of them.
    width = rest.rdd.getNumPartitions()
    while True:
        out = materialize(map_arrow(rest.select("fill", "items"), _round(capacity, full), BIN))
        left = out.filter("NOT done").count()
        finished.append(out.filter("done"))
        narrower = max(1, -(-width // FAN_IN), -(-left // CHUNK))
        if left <= 1 or width == 1 or narrower >= width:
            finished.append(out.filter("NOT done"))
            break
        width = narrower
        rest = out.filter("NOT done").repartition(width)
    done = finished[0]
    for more in finished[1:]:
        done = done.unionByName(more)
    # A bin has at most ``capacity`` items, so the running sums of its lengths are short arrays.
    before = F.expr("transform(items, (x, i) -> aggregate(slice(items, 1, i), 0L, (s, y) -> s + y.length))")
    placed = done.select(F.monotonically_increasing_id().alias("sequence_id"), "items", before.alias("offset"))
    return placed.select("sequence_id", F.explode(F.arrays_zip("items", "offset")).alias("z")).select(
        "z.items.*", "sequence_id", "z.offset"
    )


def pack_documents(
    docs: DataFrame, capacity: int = SEQUENCE, nearly_full: float = NEARLY_FULL, vocabulary: str = VOCABULARY
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of ``docs(doc_id, text)``.

    Null texts are empty, so they consist of the end id alone; special tokens in a text are ordinary text.
    Other columns are not read; rows with equal or missing doc_id are documents of their own.
    """
    return pack(materialize(pieces(docs, capacity, vocabulary)), capacity, nearly_full)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
