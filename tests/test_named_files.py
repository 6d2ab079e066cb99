import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.session import ship_package
from ledgerloom.sinks.files import write_text_files
from ledgerloom.sinks.named_files import write_named_files
from ledgerloom.sources.files import batch_files, read_directory


@pytest.fixture(autouse=True)
def _package(spark):
    ship_package(spark)


def _files(root):
    """Files that readers see; a task that outlives its failed job may still write below a hidden folder."""
    return {f: os.path.join(d, f) for d, _, names in os.walk(root) if "/_staging-" not in d for f in names}


def test_a_file_per_row_and_no_folder_per_row(spark, tmp_path):
    texts = spark.range(300).select("id", F.concat(F.lit("é\n\0 "), "id").alias("text")).repartition(3)
    write_text_files(texts, "id", "text", str(tmp_path / "out"))
    found = _files(tmp_path)
    assert len(found) == 300 and len(os.listdir(tmp_path / "out")) == 3
    assert all(open(path, "rb").read().decode() == f"é\n\0 {name[5:-4]}" for name, path in found.items())
    read = read_directory(spark, str(tmp_path / "out"), "file_1*.txt").select("length", "content").collect()
    assert len(read) == 111 and all(r["length"] == len(r["content"]) for r in read)


def test_writes_add_up_and_overwrite_replaces(spark, tmp_path):
    out = str(tmp_path / "out")
    for start in (0, 10):
        write_text_files(spark.range(start, start + 5).withColumn("t", F.lit("x")), "id", "t", out)
    assert len(_files(out)) == 10
    write_text_files(spark.range(2).withColumn("t", F.lit(None).cast("string")), "id", "t", out, mode="overwrite")
    assert {n: os.path.getsize(p) for n, p in _files(out).items()} == {"file_0.txt": 0, "file_1.txt": 0}
    write_text_files(spark.range(0).withColumn("t", F.lit("x")), "id", "t", str(tmp_path / "none"))
    assert _files(tmp_path / "none") == {}


def test_flat_files_replace_those_of_their_names(spark, tmp_path):
    out = str(tmp_path / "out")
    for text in ("old", "new"):
        names = spark.range(4 if text == "old" else 2)
        write_named_files(names, F.concat("id", F.lit(".csv")), F.lit(text), out, flat=True)
    assert {n: open(os.path.join(out, n)).read() for n in os.listdir(out)} == {
        "0.csv": "new", "1.csv": "new", "2.csv": "old", "3.csv": "old"
    }


@pytest.mark.parametrize("bad", ["a/b", "", ".hidden", "_hidden", None, "row 5"])
def test_a_failed_task_leaves_no_file(spark, tmp_path, bad):
    """The other tasks and the rows before the bad one have been written; none of that can be seen."""
    name = F.when(F.col("id") == 90, F.lit(bad)).otherwise(F.concat(F.lit("row "), F.col("id") % 10 + F.floor(F.col("id") / 50) * 10 if bad == "row 5" else "id"))
    with pytest.raises(Exception):
        write_named_files(spark.range(0, 100, 1, 2), name, F.lit("x"), str(tmp_path / "out"))
    assert _files(tmp_path) == {}


def test_names_choose_batches(spark):
    files = spark.createDataFrame([("f:/a/data_batch_1",), ("f:/a/test_batch",), ("f:/data_batch/meta",)], "path string")
    assert sorted(tuple(r) for r in batch_files(files).collect()) == [("f:/a/data_batch_1", "train"), ("f:/a/test_batch", "test")]


def test_many_small_files_share_a_task(spark, tmp_path):
    write_text_files(spark.range(400).withColumn("t", F.lit("x")), "id", "t", str(tmp_path / "out"))
    files = read_directory(spark, str(tmp_path / "out")).select("content")
    assert files.count() == 400 and files.rdd.getNumPartitions() <= 40
