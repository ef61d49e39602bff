"""Spans against brute force, disclosure of terms, sanitised texts."""

import random
import re

from tidemark.llm import pii

# Greedy forms of the contract.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    return {
        "email": True,
        "ip": kind != "ip" or all(int(p) <= 255 for p in found.split(".")),
        "card": 13 <= len(digits) <= 19 and luhn(digits),
        "phone": 9 <= len(digits) <= 15,
    }[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, h int, kind string")


def spans_of(spark, rows):
    _, spans = pii.find_spans(frame(spark, rows))
    out = {}
    for r in spans.collect():
        out.setdefault(r.doc_id, set()).add((r.kind, r.start, r.end))
    return out


def test_base_spans_match_brute_force(spark):
    rng = random.Random(8)
    bits = ["a", "b.c", "@", ".", "-", "_", "1", "22", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (22) 333-4444", "+", " ", "x@y.zz", "@d.e", "00004111111111111111", "é😀", "1.2.3.4", "\n", ","]
    rows = [(i, "".join(rng.choices(bits, k=rng.randrange(0, 25)))) for i in range(500)]
    rows += [(500, None), (501, ""), (502, "a" * 50000), (503, "9 " * 20000), (504, "a@b.c " * 3000), (505, "+1" * 9000)]
    got = spans_of(spark, rows)
    for doc, text in rows:
        assert {s for s in got.get(doc, set()) if s[0] != pii.TERM} == set(brute(text)), text[:200]


def corpus():
    filler = ["winter", "garden", "morning", "letter", "window", "street", "paper", "river"]
    rng = random.Random(1)
    noise = lambda n: " ".join(rng.choices(filler, k=n))
    rows = [(i, f"{noise(20)}.") for i in range(200)]
    rows += [(300 + i, f"{noise(6)} Quartzheim {noise(3)} write to jo.doe@mail.example {noise(5)}") for i in range(6)]
    rows += [(400, f"{noise(9)} quartzheim {noise(9)}"), (401, None), (402, "")]
    return rows


def test_disclosing_terms_are_found_everywhere(spark):
    rows = corpus()
    got = spans_of(spark, rows)
    words = {dict(rows)[d][a:b].lower() for d, s in got.items() for k, a, b in s if k == pii.TERM}
    assert "quartzheim" in words and not words & {"winter", "garden", "river"}
    assert any(k == pii.TERM for k, _, _ in got[400])


def test_copies_of_one_context_count_once(spark):
    rows = [(i, "the same zebrafink text with a@b.cc inside") for i in range(50)] + [(100 + i, "other words") for i in range(50)]
    assert all(k != pii.TERM for s in spans_of(spark, rows).values() for k, _, _ in s)


def test_sanitised_text(spark):
    rows = corpus() + [(500, "call +49 30 1234567 or 4111 1111 1111 1111 now"), (501, "at 10.0.0.1@x.yy end")]
    got = {r.doc_id: r.text for r in pii.sanitize(frame(spark, rows)).collect()}
    assert got[500] == "call [PHONE] or [CARD] now" and got[501] == "at [EMAIL] end"
    assert "[EMAIL]" in got[300] and "uartzheim" not in got[300] and "uartzheim" not in got[400]
    assert got[401] == got[402] == "" and got[0] == rows[0][1]


def test_empty_table_and_repeated_rows(spark):
    rows = [(1, "x a@b.cc"), (1, "x a@b.cc"), (None, "1.2.3.4"), (1, "other")]
    df = frame(spark, rows)
    assert sorted(r.text for r in pii.sanitize(df).collect()) == ["[IP]", "other", "x [EMAIL]", "x [EMAIL]"]
    assert pii.sanitize(df.limit(0)).count() == 0


def terms_of(spark, rows):
    out = {}
    for doc, spans in spans_of(spark, rows).items():
        out[doc] = {dict(rows)[doc][a:b].lower() for k, a, b in spans if k == pii.TERM}
    return out


def test_copied_texts_hide_no_terms(spark):
    rows = corpus()
    rows += [(1000 + 100 * n + i, text) for i in range(6) for n, text in enumerate([dict(rows)[300 + i]] * 30)]
    got = terms_of(spark, rows)
    assert all("quartzheim" in got[d] for d in (300, 305, 400, 1000, 3905))


def test_every_word_can_be_a_term_and_rows_need_no_id(spark):
    rows = [(d, (t or "").replace("Quartzheim", "user4711 李明")) for d, t in corpus() if d != 400] + [(None, "later user4711 wrote to 李明 again")]
    got = terms_of(spark, rows)
    assert all({"user4711", "李明"} <= got[d] for d in (300, 305, None))
