import datetime as dt
import pytest
from pyspark.sql import types as T

from ledgerloom.streaming.arrivals import arriving_csv, ingest_stream

SCHEMA = T.StructType().add("id", "integer").add("name", "string")
WHEN = dt.datetime(2025, 5, 3, 1, 2, 3)


def _run(spark, root, **options):
    arrivals = arriving_csv(spark, str(root / "input"), SCHEMA)
    ingest_stream(arrivals, str(root / "data"), str(root / "checkpoint"), WHEN, **options).awaitTermination()
    return spark.read.parquet(str(root / "data"))


def _arrive(root, name, text):
    path = root / "input" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_files_are_read_once(spark, tmp_path):
    _arrive(tmp_path, "a.csv", "id,name\n1,x\n2,y\n")
    _arrive(tmp_path, "notes.txt", "id,name\n8,no\n")
    assert _run(spark, tmp_path).count() == 2
    assert _run(spark, tmp_path).count() == 2
    _arrive(tmp_path, "sub/my file.b.csv", "id,name\n3,z\n")
    found = sorted((r["id"], r["dataset"], r["run"]) for r in _run(spark, tmp_path).collect())
    assert found == [
        (1, "a_20250503010203", 0),
        (2, "a_20250503010203", 0),
        (3, "my file_20250503010203", 1),
    ]


def test_plus_signs_and_spaces_in_file_names_stay(spark, tmp_path):
    _arrive(tmp_path, "x y+z/a+b c%.csv", "id,name\n1,x\n")
    (row,) = _run(spark, tmp_path).collect()
    assert row["source_key"].endswith("/x y+z/a+b c%.csv") and row["dataset"] == "a+b c%_20250503010203"


def test_the_table_follows_the_stream(spark, tmp_path):
    _arrive(tmp_path, "a.csv", "id,name\n1,x\n")
    _run(spark, tmp_path, database="arrivals", prefix="raw_")
    assert spark.table("arrivals.raw_data").count() == 1
    _arrive(tmp_path, "b.csv", "id,name\n2,y\n")
    _run(spark, tmp_path, database="arrivals", prefix="raw_")
    assert sorted(r["id"] for r in spark.table("arrivals.raw_data").collect()) == [1, 2]


def test_a_failing_batch_fails_the_run_and_is_repeated(spark, tmp_path):
    _arrive(tmp_path, "a.csv", "id,name\n1,x\n")
    with pytest.raises(Exception):
        _run(spark, tmp_path, database="not a name")
    assert _run(spark, tmp_path).count() == 1
