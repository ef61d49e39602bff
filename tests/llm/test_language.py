"""Language identification: held-out accuracy, rejection, edge cases."""

import os

import pytest

from tidemark.llm import language

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
def test_held_out_accuracy(spark):
    got = language.op10_language(spark, SF_DIR).filter("held_out").toPandas()
    true = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(true, on="doc_id")
    assert len(both) > 200 and (both.lang == both.lang_pred).mean() >= 0.99 and both.rejected.mean() < 0.01
    assert both.score.between(0, 1).all()


def small(spark):
    rows = [(i, f"the house and the garden number {i} are there", "en") for i in range(60)]
    rows += [(100 + i, f"das haus und der garten nummer {i} sind dort", "de") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_rejection_and_edges(spark):
    model = language.fit(small(spark), fit_rows=40)
    rows = [(1, "the garden"), (2, "der garten und das haus"), (3, None), (4, ""), (5, "123 !? \n"), (6, "щжючя бльфъ " * 50), (None, "the house " * 200000)]
    df = spark.createDataFrame([(*r, "zz", 0.5) for r in rows], "doc_id long, text string, lang_pred string, score double")
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert (got[1].lang_pred, got[2].lang_pred, got[None].lang_pred) == ("en", "de", "en")
    assert [got[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and all(got[i].rejected and got[i].score == 0 for i in (3, 4, 5))
    assert got[6].rejected and got[6].lang_pred in ("en", "de")
    assert not any(got[i].rejected for i in (1, 2, None))
    assert language.identify(df.limit(0), model).count() == 0


def test_nothing_to_learn(spark):
    model = language.fit(small(spark).limit(0))
    assert [tuple(r) for r in language.identify(small(spark).limit(1).select("doc_id", "text"), model).collect()] == [(0, "und", 0.0, True)]


def test_chunks_do_not_change_counts(monkeypatch):
    letters = language._letters()
    text = "Ein  Satz, noch ein Satz; 12 und mehr. " * 9
    whole = language.trigram_counts(text, letters)
    monkeypatch.setattr(language, "CHUNK_CHARS", 7)
    assert (language.trigram_counts(text, letters) == whole).all()


def test_tiny_texts_are_not_rejected(spark):
    model = language.fit(small(spark), fit_rows=40)
    df = spark.createDataFrame([(1, "Ö."), (2, "zq"), (3, "щ")], "doc_id long, text string")
    assert not any(r.rejected for r in language.identify(df, model).collect())
