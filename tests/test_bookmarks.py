import os

import pytest
from pyspark.sql import types as T

from ledgerloom.plans import bookmarks
from ledgerloom.plans.bookmarks import RUN, SOURCE, Bookmark, convert_new

SCHEMA = T.StructType().add("id", "integer").add("name", "string")


def _put(tmp_path, name, *rows, time=None):
    path = tmp_path / "input" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("id,name\n" + "".join(f"{i},{n}\n" for i, n in rows))
    if time is not None:
        os.utime(path, (time, time))


def _run(spark, tmp_path, **options):
    return [(r.files, r.rows) for r in convert_new(spark, str(tmp_path / "input"), Bookmark(str(tmp_path / "job")), SCHEMA, **options)]


def _rows(spark, tmp_path):
    return sorted((r["id"], r["name"]) for r in Bookmark(str(tmp_path / "job")).rows(spark).collect())


def test_only_new_and_rewritten_files_are_converted(spark, tmp_path):
    _put(tmp_path, "a.csv", (1, "x"), (2, "y"), time=1000)
    _put(tmp_path, "sub/b.csv", (3, "z"), time=1000)
    _put(tmp_path, "notes.txt", (9, "no"))
    assert _run(spark, tmp_path) == [(2, 3)]
    assert _run(spark, tmp_path) == []
    _put(tmp_path, "c.csv", (4, "new"))
    _put(tmp_path, "a.csv", (1, "x"), (2, "Y"), time=2000)  # of the same length
    assert _run(spark, tmp_path) == [(2, 3)]
    assert _rows(spark, tmp_path) == [(1, "x"), (2, "Y"), (3, "z"), (4, "new")]
    _put(tmp_path, "a.csv", (1, "longer"), time=2000)  # of the same time
    assert _run(spark, tmp_path) == [(1, 1)]
    assert _rows(spark, tmp_path) == [(1, "longer"), (3, "z"), (4, "new")]
    assert _run(spark, tmp_path) == []


def test_names_that_look_like_patterns(spark, tmp_path):
    for i, name in enumerate(["a[1].csv", "a1.csv", "b*.csv", "b{x,y}.csv", "c d+%41.csv", "e?.csv", "é,ü.csv"]):
        _put(tmp_path, f"some {{dir}}/{name}", (i, "x"))
    assert _run(spark, tmp_path) == [(7, 7)]
    assert [i for i, _ in _rows(spark, tmp_path)] == list(range(7))
    _put(tmp_path, "some {dir}/a[1].csv", (0, "again"), time=5)
    _put(tmp_path, "some {dir}/c d+%41.csv", (4, "again"), time=5)
    assert _run(spark, tmp_path) == [(2, 2)]
    assert [n for _, n in _rows(spark, tmp_path)] == ["again", "x", "x", "x", "again", "x", "x"]


def test_many_files_make_several_runs(spark, tmp_path):
    for i in range(7):
        _put(tmp_path, f"f{i}.csv", (i, "x"))
    assert _run(spark, tmp_path, files_per_run=3) == [(3, 3), (3, 3), (1, 1)]
    assert len(_rows(spark, tmp_path)) == 7
    ledger = Bookmark(str(tmp_path / "job")).ledger(spark)
    assert sorted({(r["number"], r["run"][:8]) for r in ledger.collect()}) == [(i, f"{i:08d}") for i in range(3)]


def test_a_run_that_fails_is_not_seen_and_is_done_again(spark, tmp_path, monkeypatch):
    _put(tmp_path, "a.csv", (1, "x"))
    _put(tmp_path, "b.csv", (2, "y"))
    real = bookmarks.write_parquet

    def failing(df, path):
        real(df, path)
        raise RuntimeError("lost after the rows were written")

    monkeypatch.setattr(bookmarks, "write_parquet", failing)
    with pytest.raises(RuntimeError):
        _run(spark, tmp_path)
    monkeypatch.undo()
    assert _run(spark, tmp_path) == [(2, 2)]
    assert len(os.listdir(tmp_path / "job" / "data")) == 2
    assert _rows(spark, tmp_path) == [(1, "x"), (2, "y")]
    found = Bookmark(str(tmp_path / "job")).rows(spark)
    assert {SOURCE, RUN} <= set(found.columns)


def test_empty_files_and_folders(spark, tmp_path):
    os.makedirs(tmp_path / "input")
    assert _run(spark, tmp_path) == []
    _put(tmp_path, "a.csv")
    assert _run(spark, tmp_path) == [(1, 0)] and _run(spark, tmp_path) == []
    assert _rows(spark, tmp_path) == []
