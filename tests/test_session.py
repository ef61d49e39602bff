"""The store of shared tables answers from the files that are there."""

import shutil

from tidemark import session
from tidemark.catalog import QUERIES

TABLES = "lineitem orders supplier nation region".split()


def test_replaced_files_are_read_anew(spark, tmp_path):
    for name in TABLES:
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path)
    run = lambda: QUERIES["d1_prices_as_of"](spark, str(tmp_path)).count()
    first = run()
    assert run() == first
    fewer = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").filter("l_orderkey % 10 = 0")
    shutil.move(tmp_path / "lineitem.parquet", tmp_path / "old")
    fewer.write.parquet(str(tmp_path / "lineitem.parquet"))
    second = run()
    assert 0 < second < first
    fewer.limit(0).write.mode("append").parquet(str(tmp_path / "lineitem.parquet"))
    assert run() == second


def test_state_follows_names_sizes_and_times(spark, tmp_path, monkeypatch):
    folder = tmp_path / "t"
    state = lambda: session.files_state(spark, [str(folder), str(tmp_path / "missing")])
    seen = [state()]
    for make in (lambda: folder.mkdir(), lambda: (folder / "a").write_text("x"), lambda: (folder / "a").write_text("xy"), lambda: (folder / "b").write_text("x")):
        make()
        seen.append(state())
    assert len(set(seen[1:])) == 4 and state() == seen[-1]
    # Large or nested folders are listed by a job.
    monkeypatch.setattr(session, "LISTED_FILES", 1)
    before = state()
    (folder / "b").write_text("xyz")
    assert before != state()
    (folder / "deep").mkdir()
    (folder / "deep" / "c").write_text("x")
    assert state() != before


def test_tables_of_the_run_are_dropped(spark):
    names = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith(session.DROPPED)}
    frame = session.stored(spark, "some key", lambda: spark.range(10), bucket_by="id")
    spark.range(3).write.saveAsTable("line_run_left_over")
    assert frame.count() == 10 and len(names()) >= 2
    session.clean_up(spark)
    assert not names()
    assert session.stored(spark, "some key", lambda: spark.range(4), bucket_by="id").count() == 4
