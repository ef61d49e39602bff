"""License scan with template automata.

A template is a license wording with markup: ``[[...]]`` may be missing, ``{{n}}`` stands for one to ``n`` words of the licensor's own,
everything else is mandatory word by word.  Templates compile to automata over words; a text is accepted where an
automaton runs from a start to its end, so one changed mandatory word rejects it.  Automata only run in texts that hold
the template's longest mandatory run of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, read

# The plain phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Wordings that several public licenses share.
_NO_WARRANTY = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of"
    " merchantability fitness for a particular purpose"
)
_DEALINGS = (
    "liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in"
    " connection with the software or the use or other dealings in the software"
)
_BSD_TERMS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions"
    " are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following"
    " disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following"
    " disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_NAMES = (
    " [[3]] neither the name of {{12}} nor the names of {{6}} may be used to endorse or promote products derived from this software without"
    " specific prior written permission"
)
_BSD_DISCLAIMER = (
    " this software is provided by {{12}} as is and any express or implied warranties including but not limited to the implied warranties"
    " of merchantability and fitness for a particular purpose are disclaimed in no event shall {{12}} be liable for any direct indirect"
    " incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss"
    " of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability"
    " or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of"
    " such damage"
)
_ISC_USE = "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = (
    " the software is provided as is and {{12}} disclaims all warranties with regard to this software including all implied warranties of"
    " merchantability and fitness in no event shall {{12}} be liable for any special direct indirect or consequential damages or any"
    " damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action"
    " arising out of or in connection with the use or performance of this software"
)


def _gnu_notice(name: str, version: str) -> str:
    return (
        f"is free software you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software"
        f" foundation either version {version} of the license or at your option any later version {{{{6}}}} is distributed in the hope that it"
        " will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
        f" see the gnu {name} for more details [[you should have received a copy of the gnu {name} along with {{{{6}}}} if not see"
        " [[http]] [[https]] www gnu org licenses]]"
    )


# Whole wordings of public licenses and of the notices that they tell authors to use, with markup.
WHOLE = {
    "0bsd": [_ISC_USE + _ISC_DISCLAIMER],
    "apache-2.0": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the"
        " license [[you may obtain a copy of the license at {{8}}]] unless required by applicable law or agreed to in writing"
        " software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"
        " either express or implied see the license for the specific language governing permissions and limitations under the license"
    ],
    "bsd-2-clause": [_BSD_TERMS + _BSD_DISCLAIMER],
    "bsd-3-clause": [_BSD_TERMS + _BSD_NAMES + _BSD_DISCLAIMER],
    "copyright": ["copyright [[c]] [[©]] {{8}} all rights reserved"],
    "gpl-2.0": [_gnu_notice("general public license", "2")],
    "gpl-3.0": [_gnu_notice("general public license", "3")],
    "isc": [
        _ISC_USE + " provided that the above copyright notice and this permission notice appear in all copies" + _ISC_DISCLAIMER
    ],
    "lgpl-2.1": [_gnu_notice("lesser general public license", "2 1")],
    "lgpl-3.0": [_gnu_notice("lesser general public license", "3")],
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction including without limitation the rights"
        " to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to"
        " whom the software is furnished to do so subject to the following conditions the above copyright notice and this"
        " permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software "
        + _NO_WARRANTY + " and noninfringement in no event shall {{12}} be " + _DEALINGS
    ],
    "mpl-2.0": [
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed"
        " with this file you can obtain one at [[http]] [[https]] mozilla org mpl 2 0"
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile"
        " sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non"
        " commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate"
        " any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at"
        " large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in"
        " perpetuity of all present and future rights to this software under copyright law "
        + _NO_WARRANTY + " and noninfringement in no event shall {{12}} be " + _DEALINGS
    ],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any"
        " damages arising from the use of this software permission is granted to anyone to use this software for any purpose including"
        " commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of"
        " this software must not be misrepresented you must not claim that you wrote the original software if you use this software in"
        " a product an acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source"
        " versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may"
        " not be removed or altered from any source distribution"
    ],
}
# Names by which a text can say in one line what it is licensed under.
NAMES = {
    "apache-2.0": ["apache 2 0", "apache license [[version]] 2 0"],
    "bsd-2-clause": ["bsd 2 clause", "2 clause bsd"],
    "bsd-3-clause": ["bsd 3 clause", "3 clause bsd"],
    "bsd": ["bsd"],
    "cc-by-4.0": ["cc by 4 0 [[international]]"],
    "cc-by-nc-4.0": ["cc by nc 4 0 [[international]]"],
    "cc-by-sa-4.0": ["cc by sa 4 0 [[international]]"],
    "cc0-1.0": ["cc0 1 0 [[universal]]"],
    "gpl-2.0": ["gplv2", "[[gnu]] gpl [[version]] 2 [[0]]", "[[gnu]] gpl v2", "gnu general public license [[version]] 2 [[0]]", "gnu general public license v2"],
    "gpl-3.0": ["gplv3", "[[gnu]] gpl [[version]] 3 [[0]]", "[[gnu]] gpl v3", "gnu general public license [[version]] 3 [[0]]", "gnu general public license v3"],
    "isc": ["isc"],
    "lgpl-2.1": ["lgplv2 1", "gnu lesser general public license [[version]] 2 1"],
    "lgpl-3.0": ["lgplv3", "gnu lesser general public license [[version]] 3 [[0]]"],
    "mit": ["mit"],
    "mpl-2.0": ["mpl 2 0", "mozilla public license [[version]] 2 0"],
}


def notices(label: str, names: list[str]) -> list[str]:
    """Templates of one-line notices: the machine-readable tag, and "licensed under ..." with each name."""
    tag = "spdx license identifier " + re.sub(r"[-.]", " ", label) + " [[only]] [[or later]]"
    free = [f"licensed under [[the]] [[a]] [[terms of the]] {n} [[license]] [[or later]]" for n in names]
    named = [f"under the [[terms of the]] {n} license" for n in names]
    return [tag, *free, *named]


TEMPLATES = {
    label: [*WHOLE.get(label, []), *(notices(label, NAMES[label]) if label in NAMES else [])] for label in sorted({*WHOLE, *NAMES})
}

# Bytes outside words become spaces: everything in ASCII but digits and a-z.
_SPACES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of one UTF-8 text: A-Z lower-cased, runs of digits, a-z and everything beyond ASCII."""
    return text.lower().translate(_SPACES).split()


@dataclass
class Automaton:
    """States are positions; ``steps[s]`` holds ``word -> state`` (``None``: any word), ``skips[s]`` the free moves."""

    label: str
    steps: list[dict[bytes | None, int]]
    skips: list[list[int]]
    final: int
    anchor: bytes

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def first_words(self) -> set[bytes]:
        return {w for s in self.closure({0}) for w in self.steps[s] if w is not None}

    def end(self, words: list[bytes], start: int) -> int:
        """End (exclusive) of the longest accepted run from ``start``, or -1."""
        now, end, i = self.closure({0}), -1, start
        while now:
            if self.final in now:
                end = i
            if i == len(words):
                break
            moved = {t for s in now for w, t in self.steps[s].items() if w is None or w == words[i]}
            now, i = self.closure(moved), i + 1
        return end


def compile_template(label: str, template: str) -> Automaton:
    steps: list[dict[bytes | None, int]] = [{}]
    skips: list[list[int]] = [[]]
    runs, run, opened = [], [], []

    def state() -> int:
        steps.append({})
        skips.append([])
        return len(steps) - 1

    for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
        at = len(steps) - 1
        plain = token[:2] not in ("[[", "]]", "{{") and not opened
        run = [*run, token.encode()] if plain else []
        runs.append(run)
        if token == "[[":
            opened.append(at)
        elif token == "]]":
            skips[opened.pop()].append(at)
        elif token.startswith("{{"):
            middle = []
            for _ in range(int(token[2:-2])):
                target = state()
                steps[target - 1][None] = target
                middle.append(target)
            for m in middle[:-1]:
                skips[m].append(middle[-1])
        else:
            target = state()
            steps[target - 1][token.encode()] = target
    return Automaton(label, steps, skips, len(steps) - 1, b" " + b" ".join(max(runs, key=len)) + b" ")


def compile_all(templates: dict[str, list[str]] = TEMPLATES) -> list[Automaton]:
    return [compile_template(label, t) for label, texts in templates.items() for t in texts]


def _starts(joined: bytes, phrase: bytes) -> list[int]:
    """Word positions where the phrase (with a space at both ends) stands in the space-joined words."""
    out, at, words = [], 0, 0
    found = joined.find(phrase)
    while found >= 0:
        words += joined.count(b" ", at, found)
        out.append(words)
        at = found
        found = joined.find(phrase, found + 1)
    return out


def scan_text(text: bytes, automata: list[Automaton]) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int]]]:
    """Number of words, places of the plain phrases (start, label), accepted templates (label, start, end)."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    base = sorted((s, label) for phrase, label in PHRASES.items() for s in _starts(joined, f" {phrase} ".encode()))
    accepted = []
    for automaton in automata:
        if automaton.anchor in joined:
            for start in sorted({s for w in automaton.first_words() for s in _starts(joined, b" " + w + b" ")}):
                end = automaton.end(words, start)
                if end >= 0:
                    accepted.append((automaton.label, start, end))
    return len(words), base, accepted


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
    " matches array<struct<label: string, start: bigint, end: bigint>>"
)
_MATCH = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """A row of ``SCHEMA`` for every row of ``docs(doc_id, text)``; other columns are not read.

    ``score`` is 1 with an accepted template, 0.5 with plain phrases only, else 0.  Null texts are empty.  ``matches``
    holds the accepted templates in word positions, end exclusive; runs from different starts may overlap.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = compile_all(templates)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                n, base, accepted = scan_text(text.as_py() or b"", automata)
                plain = {label for _, label in base}
                rows.append(
                    (
                        doc, n, len(base), base[0][0] if base else None, base[-1][0] if base else None,
                        ",".join(sorted(plain)), ",".join(sorted(plain | {a[0] for a in accepted})),
                        1.0 if accepted else 0.5 if base else 0.0,
                        [{"label": a, "start": s, "end": e} for a, s, e in accepted],
                    )
                )
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), _MATCH]
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names="doc_id n_words n_base first_word last_word base_labels labels score matches".split(),
            )

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents")).drop("matches")


ORACLE = """
WITH cleaned AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x{00}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+') AS w FROM documents
), places AS (
  SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'cc' AND w[i + 1] = 'by') AS cc,
    list_filter(range(1, len(w) + 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS gpl,
    list_filter(range(1, len(w) + 1), lambda i: w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved') AS res
  FROM cleaned
)
SELECT doc_id, len(w) AS n_words, len(cc) + len(gpl) + len(res) AS n_base,
  list_min(cc || gpl || res) - 1 AS first_word, list_max(cc || gpl || res) - 1 AS last_word,
  concat_ws(',', CASE WHEN len(cc) > 0 THEN 'cc-by' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END,
            CASE WHEN len(res) > 0 THEN 'reserved' END) AS base_labels
FROM places
"""
