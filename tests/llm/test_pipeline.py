"""The pipeline's stages, one after the other, against brute force."""

import __spark_entry__ as entry
import corpus_pipeline as pipeline
import pytest
from tidemark.llm import language

from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_simhash import brute as brute_simhash


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of the smallest table with odd rows added, and the benchmark."""
    sf, out = "/root/testdata/sf0.001", str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    extra = [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "123 456", "en", "s", 7), (9004, item, "en", "s", 1), (9005, item + " x", None, "s", 1)]
    docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumnsRenamed({}).write.parquet(f"{out}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages_match_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        before = {r.doc_id: r.text for r in docs.collect()}
        kept[name] = {r.doc_id: getattr(r, "text", None) for r in after.collect()}
        if name != "packing":
            assert after.columns == pipeline.COLUMNS
        if name == "language_id":
            assert set(before) - set(kept[name]) == {9001, 9002, 9003}
        if name == "line_dedup":
            assert kept[name] == {d: text for d, _, _, text in brute_lines(before.items())}
            assert all(r.n_chars == len(r.text) for r in after.collect())
        if name == "near_dedup":
            label = {d: c for d, (_, c) in brute_simhash(before.items()).items()}
            assert set(kept[name]) == {d for d in label if label[d] == d}
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            leaks = {d for d, t in before.items() if any(i in t for i in items)}
            assert set(before) - set(kept[name]) == leaks
        if name == "packing":
            assert set(kept[name]) == set(before)
        docs = after
    assert len(kept["packing"]) > 100


def test_run_equals_its_stages(spark, folder):
    assert entry.queries()["pipeline"] is pipeline.run
    rows = pipeline.run(spark, folder)
    assert rows.count() > 100 and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows.columns)


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[2].isdigit()) == list(range(1, 14))
    assert language.UNKNOWN == "und"


def test_rows_without_id_and_repeated_ids_are_rows_of_their_own(spark, tmp_path):
    words = lambda k: " ".join(f"w{k * i * i % 9973}" for i in range(1, 80))
    item = "A farmer sells many red apples to his old friend while it rains all day in the big city"
    first, second = item[:45], item[45:]
    rows = [(None, words(3)), (None, words(5)), (None, words(5)), (None, words(7)), (1, words(7)), (2, words(11)), (2, words(13)), (None, f"{words(17)} {item}"), (3, words(19)), (3, f"{words(23)} {item}")]
    rows += [(None, f"{words(29)} {first}"), (None, f"{second} {words(31)}")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = pipeline.keep_one_of_each_group(spark, docs, str(tmp_path))
    order = lambda found: sorted(found, key=str)
    assert order((r.doc_id, r.text) for r in left.collect()) == order(set(rows) - {(None, words(7))})
    clean = pipeline.drop_benchmark_leaks(spark, docs, str(tmp_path))
    assert order((r.doc_id, r.text) for r in clean.collect()) == order(r for r in rows if item not in r[1])
