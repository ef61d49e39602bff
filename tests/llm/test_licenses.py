"""Licence automata and plain phrases against brute force."""

import random
import re

from tidemark.llm import licenses


def test_templates():
    automaton = licenses.compile_template("x", "[[this is]] licensed by {{3}} under the [[new [[and]] good]] terms")
    accepts = lambda t: automaton.end(words := licenses.words_of(t.encode()), 0) == len(words)
    assert accepts("Licensed by me, under the terms") and accepts("This is licensed by a b c under the new and good terms")
    assert accepts("licensed by a under the new good terms")
    assert not accepts("licensed by under the terms") and not accepts("licensed by a b c d under the terms")
    assert not accepts("licensed by a under a terms") and not accepts("licensed by a under the good terms")


def plain_of(template):
    return re.sub(r"\{\{\d+\}\}", "someone", re.sub(r"\[\[|\]\]", "", template))


def labels(text):
    return {f[0] for f in licenses.scan_text(text.encode(), licenses.compile_all())[2]}


def test_each_template_accepts_its_own_wording():
    for label, texts in licenses.TEMPLATES.items():
        for t in texts:
            assert label in labels(f"Before. {plain_of(t).upper()}; after")
            assert label in labels(plain_of(re.sub(r"\[\[(?:(?!\[\[|\]\]).)*\]\]", "", t)))


def test_whole_licenses_need_every_mandatory_word():
    for label, texts in licenses.WHOLE.items():
        for t in texts:
            mandatory = re.sub(r"\[\[(?:[^\[\]]|\[\[[^\[\]]*\]\])*\]\]", "", t).split()
            automata = licenses.compile_all({label: [t]})
            assert licenses.scan_text(plain_of(" ".join(mandatory)).encode(), automata)[2]
            for i in range(0, len(mandatory), 5):
                if mandatory[i].startswith("{{"):
                    continue
                for changed in ([*mandatory[:i], "zzz", *mandatory[i + 1 :]], mandatory[:i] + mandatory[i + 1 :]):
                    assert not licenses.scan_text(plain_of(" ".join(changed)).encode(), automata)[2], (label, i)


def test_altered_tails_and_short_notices():
    mit, bsd = licenses.WHOLE["mit"][0], licenses.WHOLE["bsd-2-clause"][0]
    assert labels(plain_of(mit)) == {"mit"} and labels(plain_of(bsd)) == {"bsd-2-clause"}
    assert labels(mit.split(" the above")[0] + " you may never share this and must pay us") == set()
    assert labels(plain_of(bsd).split(" 1 ")[0] + " no redistribution at all") == set()
    assert labels(plain_of(licenses.WHOLE["bsd-3-clause"][0])) == {"bsd-3-clause"}
    for text, want in {
        "// SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3.0", "Licensed under GPLv3.": "gpl-3.0",
        "Released under the MIT License.": "mit", "licensed under CC BY-NC 4.0.": "cc-by-nc-4.0", "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "Distributed under the terms of the BSD license": "bsd",
        "She studied under MIT professors and holds a driving license.": None, "under the licence of MIT": None,
    }.items():
        assert labels(text) == ({want} if want else set()), text


def test_automata_match_brute_force():
    """Every start of an accepted run, against the same templates as patterns over whole words, on altered wordings."""

    def pattern(template):
        fixed = {"[[": "(?:", "]]": ")?"}
        tokens = re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[a-z]+", template)
        any_words = lambda t: r"(?:\S+ ){1,%s}" % t[2:-2]
        return re.compile("".join(fixed.get(t) or (any_words(t) if t[0] == "{" else f"(?:{t} )") for t in tokens))

    rng = random.Random(8)
    small = {"a": ["x [[y [[z]]]] {{2}} w"], "b": ["x y", "[[x]] z {{3}} [[w]] y"], "c": ["y [[x]] [[x]] y"]}
    automata = licenses.compile_all(small)
    patterns = [(label, pattern(t)) for label, ts in small.items() for t in ts]
    for _ in range(1500):
        words = rng.choices("xyzwv", k=rng.randrange(0, 14))
        want = set()
        for label, p in patterns:
            for i in range(len(words)):
                if p.match(" ".join(words[i:]) + " "):
                    want.add((label, i))
        got = {(label, start) for label, start, _ in licenses.scan_text(" ".join(words).encode(), automata)[2]}
        assert got == want, words


def test_base_columns_equal_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet')")
    names = "doc_id n_words n_base first_word last_word base_labels".split()
    got = sorted(tuple(r) for r in licenses.op8_licenses(spark, path).select(*names).collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({licenses.ORACLE})").fetchall())


def test_repeated_rows_clashing_columns_and_long_texts(spark):
    mit = plain_of(licenses.WHOLE["mit"][0])
    rows = [(1, mit, "x")] * 3 + [(2, "permission the copyright " * 300_000 + mit + " under" * 200_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = sorted((r.doc_id, r.labels, r.score) for r in licenses.scan_licenses(df).collect())
    assert got == [(1, "mit", 1.0)] * 3 + [(2, "mit", 1.0)]


def test_phrases_match_brute_force(spark):
    rng = random.Random(6)
    bits = ["CC", "cc", "BY", "by", "general", "public", "License", "all", "rights", "reserved", "é", "\n", "-", "  ", "x1", "\x7f", "ÀB"]
    rows = [(i, " ".join(rng.choices(bits, k=rng.randrange(0, 40)))) for i in range(150)] + [(150, None), (151, ""), (None, "cc-by")]
    df = spark.createDataFrame([(*r, "a", 1.0) for r in rows], "doc_id long, text string, labels string, score double")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    for doc, text in rows:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
        places = [(i, lab) for p, lab in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        r = got[doc]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({lab for _, lab in places})) and 0 <= r.score <= 1
    assert licenses.scan_licenses(df.limit(0)).count() == 0
