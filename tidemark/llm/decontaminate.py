"""Benchmark decontamination by template windows.

Texts are canonicalised into templates: numbers, units and names become typed placeholders, all other words are lower-cased and stripped
of punctuation.  A number with its unit (``120km``, ``50%``, ``$5``) is two words, as if written apart; in scripts without spaces every
code point is a word.  Letter case and place do not tell a name for certain, so every text has four forms: without names (a copy in
any letter case), with the capitalised words inside sentences as names, with all capitalised words as names (names that open a
sentence), and with words of other capitals (NASA, McDonald) as names too.  A run of name words is one slot.  Windows of five template words are hashed; windows with
fewer than two plain words say nothing and are left out; an item that has no other windows is searched for word by word, with its own numbers and names.  A document is
a candidate for an item when it holds at least 0.8 of the item's windows, each in some form.
Names that are exchanged in a text without capitals, or in capitals only, are not seen as names.
Candidates are aligned word by word: equal values of the item's slots must have equal values in the text within each type, so a question with
exchanged numbers or names is caught, while a text that only shares the phrasing is not.
"""

from __future__ import annotations

import re
import sys
import types
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import NO_ID, map_arrow, read, text_hash, within
from tidemark.session import materialize

WINDOW = 5
SIMILARITY = 0.8
PLAIN_WORDS = 2
# Benchmarks of up to so many distinct windows are sent to the tasks as a filter; larger ones are joined by shuffle only.
FILTER_WINDOWS = 1_000_000
# Codes of words are kept for so many words of at most so many characters.
WORDS = 150_000
KEPT_CHARS = 64

# Unit and number words.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hrs day days week weeks month months year years "
    "hour hours minute minutes second seconds meter meters metre metres kilometer kilometers mile miles foot feet inch inches gram grams "
    "kilogram kilograms pound pounds liter liters litre litres percent dollar dollars euro euros cent cents degree degrees "
    "% $ € £ ¥ °c °f km/h mph".split()
)
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
BREAK = "\x00"
# MEASURE is a number with its unit, CAPITALS a word with other capitals than its first, BARRIER the end of a text among others.
PLAIN, NUMBER, UNIT, NAME, SKIP, MEASURE, CAPITALS, BARRIER = range(8)
_STRIP = re.compile(r"^[\W_]+|[\W_]+$")
_NUMBER = re.compile(r"[$€£¥]?[+-]?\d+(?:[.,:/]\d+)*(%|[^\W\d_]{1,3})?")
_MEASURE = re.compile(r"[^\w$€£¥]*([$€£¥]?)(\d+(?:[.,:/]\d+)*)(%|°?[^\W\d_]{1,12}(?:/[^\W\d_]{1,3})?|)[^\w%]*")
# Blocks of scripts that are written without spaces (Thai, Lao, Tibetan, Myanmar, Khmer, Kana, Han).
_SPACELESS = re.compile("[\u0E00-\u0FFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\U00020000-\U000323AF]")
_ENDS = (".", "!", "?", ":", "。", "！", "？")
# Low bits of a word's code: 0-2 kind without names, 3-5 kind with names, 6 ends a sentence, 7 ends in a letter or digit, so that a name
# may go on.  The rest is the hash of the plain word.
_FLAGS = 8
# Forms of a text: no word is a name; capitalised words inside sentences are names; all capitalised words are names; words of other capitals too.
NO_NAMES, INNER_NAMES, ALL_NAMES, WIDE_NAMES = FORMS = range(4)
# Form of items without template windows: all words, also numbers and units, are plain.
LITERAL = 4
_BITS = 20
_PLACEHOLDER = np.array([0, 0x51ED270B9F1, 0x2545F4914F7, 0x9E3779B97F5, 0, 0, 0, 0], np.uint64)
_POWERS = [pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(WINDOW)]


def measure(word: str) -> tuple[str, str] | None:
    """Number and unit of a word that holds both."""
    found = _MEASURE.fullmatch(word)
    unit = found and (found[1] or found[3])
    return (found[2], unit) if unit and unit.lower() in UNITS and not (found[1] and found[3]) else None


class WordCodes(dict):
    """Code of a word between white space; None is the barrier between texts."""

    def __missing__(self, word: str | None) -> int:
        if word is None:
            code = 1 << 6 | BARRIER << 3 | BARRIER
        elif word.isalpha():
            code = self.plain(word, word) | 1 << 7
        elif word[-1] in ".,;:!?" and word[:-1].isalpha():
            code = self.plain(word, word[:-1]) | (word[-1] in _ENDS) << 6
        else:
            code = self.other(word)
        if len(self) >= WORDS:
            self.clear()
        if word is None or len(word) <= KEPT_CHARS:
            self[word] = code
        return code

    def plain(self, word: str, bare: str) -> int:
        """Hash and kinds of a word that is no number in digits."""
        low = bare.lower()
        if low in UNITS:
            first = later = UNIT
        elif low in NUMBER_WORDS:
            first = later = NUMBER
        else:
            first = later = PLAIN
            if low != bare and len(bare) > 1:
                later = NAME if bare[0] != low[0] and bare[1:] == low[1:] else CAPITALS
        return xxhash.xxh64_intdigest(low) >> _FLAGS << _FLAGS | later << 3 | first

    def other(self, word: str) -> int:
        bare = _STRIP.sub("", word)
        ends = word == BREAK or word.rstrip("\"')]}»”’")[-1:] in _ENDS
        if word in UNITS:
            code = xxhash.xxh64_intdigest(word) >> _FLAGS << _FLAGS | UNIT << 3 | UNIT
        elif not bare:
            code = SKIP << 3 | SKIP
        elif measure(word):
            code = MEASURE << 3 | MEASURE
        elif _NUMBER.fullmatch(bare):
            code = xxhash.xxh64_intdigest(bare.lower()) >> _FLAGS << _FLAGS | NUMBER << 3 | NUMBER
        else:
            code = self.plain(word, bare)
        return code | word[-1:].isalnum() << 7 | ends << 6


def codes_of() -> WordCodes:
    kept = sys.modules.setdefault("_tidemark_word_codes", types.ModuleType("_tidemark_word_codes"))
    if not hasattr(kept, "codes"):
        kept.codes = WordCodes()
    return kept.codes


def split_words(text: str) -> list[str]:
    """Words between white space, line ends as words of their own, and single code points of scripts without spaces."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        text = _SPACELESS.sub(r" \g<0> ", text)
    return text.replace("\n", f" {BREAK} ").split()


class Template:
    """Words of a text, or of texts with barriers between them, without those that are only punctuation, and their forms."""

    def __init__(self, words: list[str | None], codes: WordCodes) -> None:
        code = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
        split = np.flatnonzero(code & np.uint64(7) == MEASURE)
        if len(split):
            parts = [measure(words[i]) for i in split]
            last = code[split] & np.uint64(3 << 6)
            code[split] = np.array([codes[number] for number, _ in parts], np.uint64)
            units = np.array([codes[unit.lower()] for _, unit in parts], np.uint64) & ~np.uint64(3 << 6)
            code = np.insert(code, split + 1, units | last)
        ends = (code >> np.uint64(6) & np.uint64(1)) == 1
        opens = np.concatenate(([True], ends[:-1])) if len(code) else ends
        kind = (code & np.uint64(7)).astype(np.int8)
        keep = kind != SKIP
        # The words of a name follow each other without punctuation.
        joins = (code >> np.uint64(7) & np.uint64(1)) == 1
        self.goes_on = np.concatenate(([False], (joins & keep)[:-1]))[keep] if len(code) else ends
        code = code[keep]
        self.kind, self.opens = kind[keep], opens[keep]
        later = code >> np.uint64(3) & np.uint64(7)
        self.capital, self.capitals = later == NAME, later == CAPITALS
        self.value = code >> np.uint64(_FLAGS)

    def names(self, form: int) -> np.ndarray:
        """Marks of the words that are names in a form."""
        if form == WIDE_NAMES:
            return self.capital | self.capitals
        return self.capital if form == ALL_NAMES else self.capital & ~self.opens

    def form(self, form: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Template word hashes, kinds, value hashes and first words of the tokens of a form; a run of name words is one token."""
        kind, value, first = self.kind, self.value, np.arange(len(self.kind))
        if form == LITERAL:
            kind = np.full(len(kind), PLAIN)
        elif form != NO_NAMES:
            names = self.names(form)
            kind = np.where(names, NAME, kind)
            inside = names & np.concatenate(([False], names[:-1])) & self.goes_on if len(names) else names
            if inside.any():
                first = np.flatnonzero(~inside)
                kind, joined = kind[first], value[first].copy()
                for at in np.flatnonzero(inside):  # words of a name after its first, in their order
                    token = np.searchsorted(first, at, "right") - 1
                    joined[token] = (int(joined[token]) * 0x100000001B3 ^ int(value[at])) & (1 << 64) - 1
                value = joined
        return np.where(kind == PLAIN, value, _PLACEHOLDER[kind]), kind, value, first

    def search(self, form: int, size: int, seen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Text numbers and window hashes of a form, without those that an earlier form has as well.

        ``seen``: marks of the low bits of word values; windows with another plain word are left out.
        """
        kind, value, needed = self.kind, self.value, None
        text = np.cumsum(kind == BARRIER)
        if form == LITERAL:
            kind = np.where(kind == BARRIER, kind, PLAIN)
        elif form != NO_NAMES:
            names = self.names(form)
            marks = self.capitals if form == WIDE_NAMES else names
            if not marks.any():
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            first = ~(names & np.concatenate(([False], names[:-1])) & self.goes_on)
            start = np.flatnonzero(first)
            # A token stands for a name of one or more words; only windows with a marked one are new.
            needed = np.logical_or.reduceat(marks & names, start)
            kind, value, text = np.where(names, NAME, kind)[start], value[start], text[start]
        n = len(kind) - size + 1
        if n <= 0 or not size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        plain = kind == PLAIN
        bad = kind == BARRIER
        if seen is not None:
            bad = bad | plain & ~seen[(value & np.uint64((1 << _BITS) - 1)).astype(np.int64)]
        good = (_inside(bad, size) == 0) & (_inside(plain, size) >= PLAIN_WORDS)
        if needed is not None:
            good &= _inside(needed, size) > 0
        at = np.flatnonzero(good)
        words = np.where(plain, value, _PLACEHOLDER[kind])
        return text[at], hashes(words, at, size)


def _inside(marks: np.ndarray, size: int) -> np.ndarray:
    """Marks in each window."""
    total = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
    return total[size:] - total[:-size]


def hashes(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Signed hashes of the windows that start at ``at``."""
    out = np.full(len(at), size, np.uint64)
    for i, power in enumerate(_POWERS[:size]):
        part = words[at + i]
        out += (part ^ part >> np.uint64(29)) * np.uint64(power)
    return ((out ^ out >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def windows(words: np.ndarray, kind: np.ndarray, size: int) -> np.ndarray:
    """Signed window hashes by start; zero where a window has too few plain words."""
    n = len(words) - size + 1
    if n <= 0 or not size:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(_inside(kind == PLAIN, size) >= PLAIN_WORDS)
    out = np.zeros(n, np.int64)
    out[at] = hashes(words, at, size)
    return out


def item_windows(text: str, codes: WordCodes) -> set[tuple[int, int, int, int]]:
    """``form, size, slot, hash``: the windows of the coarsest form that has whole windows are the slots, each with its hash in every form."""
    item = Template(split_words(text), codes)
    forms = []
    for form in FORMS:
        words, kind, _, first = item.form(form)
        size = min(WINDOW, len(words))
        forms.append((form, size, windows(words, kind, size), first))
    usable = [f for f in forms if f[2].any()]
    if not usable:
        words, kind, _, first = item.form(LITERAL)
        size = min(WINDOW, len(words))
        usable = [(LITERAL, size, windows(words, kind, size), first)]
    _, _, base, first = max(usable, key=lambda f: (f[1], f[0]))
    slot_of: dict[int, int] = {}
    rows = set()
    for at, h in enumerate(base.tolist()):
        if not h:
            continue
        slot = slot_of.setdefault(h, at)
        for form, size, found, starts in usable:
            token = min(int(np.searchsorted(starts, first[at], "right")) - 1, len(found) - 1)
            if found[token]:
                rows.add((form, size, slot, int(found[token])))
    return rows


def _item_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = codes_of()
    for batch in batches:
        rows = [
            (item, *row)
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for row in sorted(item_windows(text or "", codes))
        ]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["item_id", "form", "size", "slot", "hash"]
        )


def _item_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Low bits of the values of the items' words."""
    codes, found = codes_of(), np.zeros(1 << _BITS, bool)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            found[(Template(split_words(text or ""), codes).value & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(found))], names=["low"])


def _document_windows(sizes: list[tuple[int, int]], wanted: np.ndarray | None, words: np.ndarray | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, low, seen_words = codes_of(), np.int64((1 << _BITS) - 1), None
        if wanted is not None:
            seen, seen_words = np.zeros(1 << _BITS, bool), np.zeros(1 << _BITS, bool)
            seen[wanted & low] = True
            seen_words[words] = True
        for batch in batches:
            # All texts of a batch in one template: per-text calls would cost more than the windows.
            every: list[str | None] = []
            for text in batch.column(1):
                every += split_words(text.as_py())
                every.append(None)
            template = Template(every, codes)
            del every
            texts, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for form, size in sizes:
                text, found = template.search(form, size, seen_words)
                keep = found != 0
                if wanted is not None and len(wanted):
                    keep &= seen[found & low]
                    at = np.flatnonzero(keep)
                    keep[at] = wanted[np.minimum(np.searchsorted(wanted, found[at]), len(wanted) - 1)] == found[at]
                texts.append(text[keep])
                values.append(found[keep])
            text, found = np.concatenate(texts), np.concatenate(values)
            order = np.lexsort((found, text))
            text, found = text[order], found[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (found[1:] != found[:-1])
            rows = pa.array(text[new])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(2).take(rows), pa.array(found[new])], names=["id", "h", "hash"])

    return run


def align(item: str, text: str, codes: WordCodes) -> tuple[str, int]:
    """``exact``, ``reparameterised`` or ``inconsistent``, and the number of changed slots, at the best place of the text."""
    a, t = Template(split_words(item), codes), Template(split_words(text), codes)
    ranked = []
    templates = any(windows(*f[:2], min(WINDOW, len(f[0]))).any() for f in map(a.form, FORMS))
    for form in FORMS if templates else [LITERAL]:
        a_words, a_kind, a_value, _ = a.form(form)
        t_words, t_kind, t_value, _ = t.form(form)
        size = min(WINDOW, len(a_words))
        places: dict[int, list[int]] = {}
        total = 0
        for i, h in enumerate(windows(a_words, a_kind, size).tolist()):
            if h:
                places.setdefault(h, []).append(i)
                total += 1
        shifts = Counter(
            j - i for j, h in enumerate(windows(t_words, t_kind, size).tolist()) if h in places for i in places[h]
        )
        if not shifts:
            continue
        best, verdict = max(shifts.values()), None
        for shift in sorted(s for s, n in shifts.items() if n >= SIMILARITY * best):
            lo, hi = max(0, -shift), min(len(a_words), len(t_words) - shift)
            same = (a_words[lo:hi] == t_words[lo + shift : hi + shift]) & (a_kind[lo:hi] != PLAIN)
            pairs = {(int(k), int(u), int(v)) for k, u, v in zip(a_kind[lo:hi][same], a_value[lo:hi][same], t_value[lo + shift : hi + shift][same], strict=True)}
            changed = sum(u != v for _, u, v in pairs)
            fits = len({p[:2] for p in pairs}) == len(pairs)
            if (not changed or fits) and (verdict is None or changed < verdict):
                verdict = changed
        ranked.append((best / total, verdict))
    # The form that holds most of the item decides; another one only where it also holds enough.
    top = max((r[0] for r in ranked), default=0)
    for share in sorted({r[0] for r in ranked if r[0] >= min(top, SIMILARITY)}, reverse=True):
        told = [r[1] for r in ranked if r[0] == share and r[1] is not None]
        if told:
            return ("reparameterised", min(told)) if min(told) else ("exact", 0)
    return "inconsistent", 0


def _aligned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = codes_of()
    for batch in batches:
        rows = [align(r["item"] or "", r["text"] or "", codes) for r in batch.select(["item", "text"]).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("h"), batch.column("item_id"), batch.column("similarity"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())],
            names=["id", "h", "item_id", "similarity", "kind", "changed_slots"],
        )


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, rows: bool = False) -> DataFrame:
    """``id, item_id, similarity, kind, changed_slots``: a row for each document and item that it leaks.

    ``docs`` needs ``doc_id, text`` and ``benchmark`` needs ``item_id, text``; other columns are not read.  ``id`` is doc_id, or the
    largest long for rows without one; rows with equal doc_id are one document, rows without one are
    documents of their own.  ``rows``: every row is a document, and ``h``, the hash of its text, is the second column.  ``similarity`` is the share of the item's
    distinct windows found in the document in any form.  ``kind`` is exact or reparameterised.  Items of fewer than five words are one window of their length;
    items without a window of two plain words are found only word by word.  Items of one word (in scripts without spaces: of one
    code point), null and empty texts match nothing.
    """
    key = text_hash() if rows else F.when(F.col("doc_id").isNull(), text_hash()).otherwise(F.lit(0))
    source = docs.select(
        F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("id"), F.coalesce("text", F.lit("")).cast("string").alias("text"), key.cast("long").alias("h")
    )
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    own = materialize(map_arrow(items, _item_windows, "item_id long, form int, size int, slot int, hash long").distinct())
    sizes = sorted(tuple(r) for r in own.select("form", "size").distinct().collect())  # at most WINDOW numbers a form
    wanted = words = None
    keys = own.select("hash").distinct()
    if keys.limit(FILTER_WINDOWS + 1).count() <= FILTER_WINDOWS:
        wanted = np.sort(np.array([r[0] for r in keys.collect()], np.int64))
        # At most 2 ** _BITS numbers.
        words = np.array([r[0] for r in map_arrow(items.select("text"), _item_words, "low long").distinct().collect()], np.int64)
    found = map_arrow(source, _document_windows(sizes, wanted, words), "id long, h long, hash long")
    total = own.groupBy("item_id").agg(F.count_distinct("slot").alias("total"))
    hits = (
        found.distinct()
        .join(within(own.select("item_id", "slot", "hash").distinct()), "hash")
        .groupBy("id", "h", "item_id")
        .agg(F.count_distinct("slot").alias("hits"))
        .join(total, "item_id")
        .select("id", "h", "item_id", (F.col("hits") / F.col("total")).alias("similarity"))
        .filter(F.col("similarity") >= similarity)
    )
    pairs = materialize(hits)
    texts = source.join(within(pairs.select("id", "h", "item_id", "similarity")), ["id", "h"])
    both = texts.join(items.withColumnRenamed("text", "item"), "item_id").select("id", "h", "item_id", "similarity", "item", "text")
    kinds = "id long, h long, item_id long, similarity double, kind string, changed_slots long"
    checked = map_arrow(both, _aligned, kinds).filter("kind <> 'inconsistent'")
    return checked.groupBy("id", *(["h"] if rows else []), "item_id").agg(
        F.max("similarity").alias("similarity"), F.min("kind").alias("kind"), F.min("changed_slots").alias("changed_slots")
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        F.when(F.col("id") < NO_ID, F.col("id")).alias("doc_id"),
        "item_id",
        F.round("similarity", 6).alias("similarity"),
        "kind",
        "changed_slots",
    )
