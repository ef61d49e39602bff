"""Template windows and slot consistency."""

import random

import numpy as np
import pytest

from tidemark.llm import decontaminate as d

ITEM = "A farmer sells 12 apples to Maria and then 30 pears to Peter. Later Maria gives 12 apples back. How many km did Peter walk?"


def found(spark, texts, items, **options):
    docs = spark.createDataFrame([(*t, 0, "x") for t in texts], "doc_id long, text string, id int, hash string")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, total int")
    return {(r.id, r.item_id): (r.kind, r.changed_slots) for r in d.contaminated(docs, bench, **options).collect()}


def texts():
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("lor", "mip", "sum", "dol") for b in ("ane", "iro", "ute")]
    noise = lambda: " ".join(rng.choices(words, k=60))
    changed = ITEM.replace("12", "45").replace("30", "99").replace("Maria", "Anna").replace("Peter", "Otto").replace("km", "miles")
    broken = ITEM.replace("sells 12", "sells 45").replace("30", "99")
    return [
        (1, f"{noise()} {ITEM} {noise()}"), (2, f"{noise()}\n{ITEM.upper()}\n{noise()}"), (3, f"{noise()}. {changed} {noise()}"),
        (4, f"{noise()}. {broken} {noise()}"), (5, noise()), (6, None), (7, ""), (8, "12 30 " * 4000), (None, ITEM), (9, ITEM[:50]), (1, noise()),
    ]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_kinds(spark, monkeypatch, limit):
    monkeypatch.setattr(d, "FILTER_WINDOWS", limit)  # 0: joined by shuffle, without the filter in the tasks
    got = found(spark, texts(), [(70, ITEM), (71, "12 30 45 99 12"), (72, None), (73, "two words")])
    assert got == {
        (1, 70): ("exact", 0), (3, 70): ("reparameterised", 5), (d.NO_ID, 70): ("exact", 0),
    } | ({(2, 70): got[2, 70]} if (2, 70) in got else {})


def test_similarity_counts_windows(spark):
    words = [f"w{chr(97 + i)}" for i in range(26)]
    item = " ".join(words)
    part = lambda n: " ".join(words[:n])
    got = found(spark, [(n, part(n)) for n in (26, 22, 21, 10)], [(1, item)])
    assert got == {(26, 1): ("exact", 0), (22, 1): ("exact", 0)}  # 22, 18, 17 and 6 of 22 windows


def test_empty_tables(spark):
    assert found(spark, [(1, ITEM)], []) == {} and found(spark, [], [(1, ITEM)]) == {}


def test_every_whole_item_is_found_in_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = {(r.doc_id, i.item_id) for r in docs for i in items if i.text in r.text}
    got = {(r.doc_id, r.item_id) for r in d.op1_decontaminate(spark, sf).collect()}
    assert want == got


def test_letter_case_and_place_do_not_hide_names(spark):
    item = "Maria gives 12 red apples to her old friend. Maria walks home with the empty basket. Peter takes 30 pears from the tall tree. Who has more fruit now?"
    other = item.replace("Maria", "Anna").replace("Peter", "Otto")
    longer = ITEM.replace("Maria", "Anna Lee").replace("Peter", "Otto von Berg")
    rows = [(1, ITEM.upper()), (2, ITEM.lower()), (3, other), (4, longer), (5, item.replace("Maria", "Anna Lee")), (6, item.replace("Maria gives", "Anna gives"))]
    got = found(spark, [(i, f"some words. {t} Some words") for i, t in rows], [(70, ITEM), (71, item)])
    assert {k: v[0] for k, v in got.items() if k[0] != 6} == {
        (1, 70): "exact", (2, 70): "exact", (3, 71): "reparameterised", (4, 70): "reparameterised", (5, 71): "reparameterised",
    }
    assert got[3, 71] == ("reparameterised", 2) and got[5, 71] == ("reparameterised", 1)


def test_different_values_may_become_equal(spark):
    item = "Our basket holds 3 green apples and 5 yellow pears today, so how many fruits are in it?"
    rows = [(1, item.replace("3", "4").replace("5", "4")), (2, item.replace("5", "3")), (3, item)]
    assert found(spark, rows, [(1, item)]) == {(1, 1): ("reparameterised", 2), (2, 1): ("reparameterised", 1), (3, 1): ("exact", 0)}


def test_items_without_template_windows_are_found_word_by_word(spark):
    items = [(1, "Compute 12 * 7"), (2, "1 2 4 8 16 32 64"), (3, "Anna 12 kg"), (4, "12"), (5, "* *")]
    rows = [(1, "so compute 12 * 7 now"), (2, "so compute 12 * 8 now"), (3, "it is 1 2 4 8 16 32 64 and on"), (4, "1 2 4 8 17 32 64"), (5, "ANNA 12 kg"), (6, "12")]
    assert found(spark, rows, items) == {(1, 1): ("exact", 0), (3, 2): ("exact", 0), (5, 3): ("exact", 0)}


def test_scripts_without_spaces_are_matched_by_code_point(spark):
    zh = "小明有12个苹果，他给了小红5个苹果，然后又买了8个苹果。请问小明现在一共有多少个苹果？"
    ja = "たろうさんはりんごを3個持っています。はなこさんに1個あげました。残りはいくつですか。"
    rows = [(1, f"前言{zh}后记"), (2, zh.replace("12", "45").replace("8", "99")), (3, ja), (4, "今天天气很好，我们去公园散步，看到了很多花和树。"), (5, zh[:20])]
    assert found(spark, rows, [(1, zh), (2, ja), (3, "好")]) == {(1, 1): ("exact", 0), (2, 1): ("reparameterised", 2), (3, 2): ("exact", 0)}


def test_numbers_with_their_units(spark):
    item = "The train goes 120 km in 2 hours and burns 50 % of its fuel, which costs 30 dollars. How far does it go then?"
    glued = item.replace("120 km", "120km").replace("2 hours", "2h").replace("50 %", "50%").replace("30 dollars", "$30")
    got = found(spark, [(1, glued), (2, glued.replace("120", "90")), (3, item.replace("120 km", "75miles"))], [(1, item)])
    assert {k: v[0] for k, v in got.items()} == dict.fromkeys([(1, 1), (2, 1), (3, 1)], "reparameterised")
    assert d.measure("$12.50,") == ("12.50", "$") and d.measure("(5km/h)") == ("5", "km/h") and d.measure("3rd") is None and d.measure("12") is None
    assert d.Template(d.split_words("5km, 5 km 5 KM. 50%"), d.WordCodes()).kind.tolist() == [d.NUMBER, d.UNIT] * 4


@pytest.mark.parametrize("name", ["NASA", "McDonald", "O'Brien", "iPhone Ltd", "Bob", "IBM Research"])
def test_names_in_other_capitals(spark, name):
    item = "When Maria buys 12 red apples from Peter she pays with a coin. Later Maria sells 7 of the apples to a friend of Peter. How many are left?"
    rows = [(1, item.replace("Maria", name)), (2, item.replace("Peter", name))]
    got = found(spark, rows, [(1, item)])
    # Together with the words that open the sentences, a name may be more than one slot.
    assert [got[i, 1][0] for i in (1, 2)] == ["reparameterised"] * 2 and max(n for _, n in got.values()) <= 2


def test_search_in_batches_equals_text_by_text():
    rng = random.Random(5)
    words = ["Maria", "NASA", "12", "5km", "km", "red", "apples", "he", "buys", ".", "\n", "and", "O'Brien", "\x00", "three", "“so", "x" * 90]
    codes = d.WordCodes()
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 4, 30]))) for _ in range(200)]
    batch = d.Template([w for t in texts for w in (*d.split_words(t), None)], codes)
    seen = np.zeros(1 << d._BITS, bool)
    seen[[int(v) & (1 << d._BITS) - 1 for v in d.Template(d.split_words(" ".join(words[3:])), codes).value]] = True
    for filtered in (None, seen):
        got = {t: set() for t in range(len(texts))}
        for form in (*d.FORMS, d.LITERAL):
            for t, h in zip(*batch.search(form, 5, filtered), strict=True):
                got[int(t)].add(int(h))
        for t, text in enumerate(texts):
            one = d.Template(d.split_words(text), codes)
            want = set()
            for form in (*d.FORMS, d.LITERAL):
                tokens, kind, value, _ = one.form(form)
                bad = [filtered is not None and k == d.PLAIN and not seen[int(v) & (1 << d._BITS) - 1] for k, v in zip(kind, tokens, strict=True)]
                want |= {int(h) for i, h in enumerate(d.windows(tokens, kind, 5)) if h and not any(bad[i : i + 5])}
            assert got[t] == want


def test_codes_are_bounded(monkeypatch):
    monkeypatch.setattr(d, "WORDS", 10)
    codes = d.WordCodes()
    fresh = [codes[f"w{i}"] for i in range(50)]
    assert len(codes) <= 10 and [codes[f"w{i}"] for i in range(50)] == fresh
    assert codes["y" * 1000] == codes["y" * 1000] and "y" * 1000 not in codes
