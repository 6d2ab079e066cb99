import os
import shutil

import pytest

from ledgerloom.sources.catalog import register_table, schema_changes, schema_report
from ledgerloom.sources.evolution import parquet_files, partition_changes, sync_partitions, wider_type


def test_register_discovers_columns_and_partitions(spark, tmp_path):
    path = str(tmp_path / "sales")
    spark.sql("select 1 as id, 'x' as kind union all select 2, 'y'").write.partitionBy("kind").parquet(path)
    table = register_table(spark, path, "discovered", "cur_")
    assert table == "discovered.cur_sales"
    assert sorted(tuple(r) for r in spark.table(table).select("id", "kind").collect()) == [(1, "x"), (2, "y")]


def test_register_again_adds_columns_and_keeps_missing_ones(spark, tmp_path):
    path = str(tmp_path / "growing")
    spark.sql("select 1 as id, 'a' as gone").write.parquet(f"{path}/day=1")
    register_table(spark, path, "evolving")
    spark.sql("select 2 as id, 2.5D as added, named_struct('k', 1) as nested").write.parquet(f"{path}/day=2")
    table = register_table(spark, path, "evolving")
    found = {r["id"]: (r["gone"], r["added"], r["nested"], r["day"]) for r in spark.table(table).collect()}
    assert found == {1: ("a", None, None, 1), 2: (None, 2.5, (1,), 2)}


def test_types_widen_on_registration_again(spark, tmp_path):
    path = str(tmp_path / "it's wider")
    spark.sql("select 1 as a, 2 as b, cast(1.5 as float) as c").write.parquet(f"{path}/day=1")
    table = register_table(spark, path, "widening", name="t")
    spark.sql("select 5000000000 as a, 2.5D as b, 2.5D as c, 'x' as d").write.parquet(f"{path}/day=2")
    assert register_table(spark, path, "widening", name="t") == table
    found = spark.table(table)
    assert dict(found.dtypes) == {"a": "bigint", "b": "double", "c": "double", "d": "string", "day": "int"}
    assert sorted(tuple(r) for r in found.select("a", "b", "c", "d", "day").collect()) == [
        (1, 2.0, 1.5, None, 1),
        (5000000000, 2.5, 2.5, "x", 2),
    ]


@pytest.mark.parametrize(
    "one, two, wider",
    [
        ("int", "bigint", "bigint"), ("double", "int", "double"), ("smallint", "int", "int"), ("float", "int", "double"),
        ("bigint", "double", "double"), ("float", "bigint", "double"), ("int", "string", "string"), ("boolean", "int", "string"),
        ("decimal(10,2)", "decimal(8,4)", "decimal(12,4)"), ("int", "decimal(5,3)", "decimal(13,3)"),
        ("decimal(38,0)", "decimal(38,10)", "string"), ("decimal(5,1)", "double", "double"), ("date", "timestamp", "timestamp"),
        ("date", "timestamp_ntz", "timestamp_ntz"), ("decimal(5,1)", "date", "string"), ("array<int>", "array<bigint>", "array<bigint>"),
    ],
)
def test_wider_types(one, two, wider):
    assert wider_type(one, two) == wider
    assert "<" in one or wider_type(two, one) == wider


def _found(spark, table, *columns):
    return sorted((tuple(r) for r in spark.table(table).select(*columns).collect()), key=str)


def test_types_that_need_casts_are_united(spark, tmp_path):
    path = str(tmp_path / "mixed types")
    spark.sql("select 9007199254740993 as a, 'x' as b, 1 as c").write.parquet(f"{path}/day=1/kind=p q")
    assert register_table(spark, path, "united", name="t") == "united.t"
    spark.sql("select 2.5D as a, 7 as b, 5000000000 as c, true as d").write.parquet(f"{path}/day=2/kind=r")
    table = register_table(spark, path, "united", name="t")
    types = {"a": "double", "b": "string", "c": "bigint", "d": "boolean", "day": "int", "kind": "string"}
    assert dict(spark.table(table).dtypes) == types
    first, second = (9007199254740992.0, "x", 1, None, 1, "p q"), (2.5, "7", 5000000000, True, 2, "r")
    assert _found(spark, table, *types) == sorted([first, second], key=str)

    # More files of both kinds, a null partition, and a folder that goes.
    spark.sql("select 3 as a, 'y' as b, 1 as c").write.parquet(f"{path}/day=__HIVE_DEFAULT_PARTITION__/kind=s")
    shutil.rmtree(f"{path}/day=2")
    spark.sql("select 4.5D as a, 'z' as b, 1 as c").write.parquet(f"{path}/day=4/kind=r")
    assert register_table(spark, path, "united", name="t") == table
    assert _found(spark, table, "a", "day") == [(3.0, None), (4.5, 4), (9007199254740992.0, 1)]
    plan = spark.table(table).where("day = 4").select("a")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [") == 2 and "PartitionFilters: []" not in plan
    assert "ReadSchema: struct<a:double>" in plan and "ReadSchema: struct<a:bigint>" in plan

    # Once all files are of one kind again, a plain table.
    shutil.rmtree(f"{path}/day=4")
    register_table(spark, path, "united", name="t")
    assert spark.catalog.getTable(table).tableType == "EXTERNAL"
    assert _found(spark, table, "a", "day") == [(3, None), (9007199254740993, 1)]


def test_files_of_one_folder_that_need_different_casts_are_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    for sql in ("select 1L as a", "select 1.5D as a"):
        spark.sql(sql).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="folder"):
        register_table(spark, path, "refused")


def test_files_of_other_writers(spark, tmp_path):
    """Footers without Spark's own schema."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    for folder, kind in (("kind=one", pa.int64()), ("kind=two", pa.float64())):
        os.makedirs(tmp_path / "t" / folder)
        pq.write_table(pa.table({"a": pa.array([1, 2], kind), "n": pa.array(["x", None])}), tmp_path / "t" / folder / "f.parquet")
    table = register_table(spark, str(tmp_path / "t"), "others")
    assert _found(spark, table, "a", "n") == sorted([(1.0, "x"), (2.0, None)] * 2, key=str)


def test_partitions_are_found_by_difference(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "parts")
    for day in (1, 2, 3):
        spark.range(day).write.parquet(f"{path}/day={day}/kind=a%3Db")
    table = register_table(spark, path, "differences")
    folders = parquet_files(spark, path)
    assert partition_changes(spark, table, folders).isEmpty()
    spark.range(7).write.parquet(f"{path}/day=4/kind=c")
    shutil.rmtree(f"{path}/day=2")
    altered = []
    real = type(spark).sql
    monkeypatch.setattr(type(spark), "sql", lambda self, text, *a, **k: altered.append(text) or real(self, text, *a, **k))
    changes = sync_partitions(spark, table, path, parquet_files(spark, path))
    monkeypatch.undo()
    assert [t.count("PARTITION (") for t in altered if t.startswith("ALTER")] == [1]
    assert sorted(map(tuple, changes.collect())) == [("added", "day=4/kind=c"), ("vanished", "day=2/kind=a%3Db")]
    counts = {(r["day"], r["kind"]): r["count"] for r in spark.table(table).groupBy("day", "kind").count().collect()}
    assert counts == {(1, "a=b"): 1, (3, "a=b"): 3, (4, "c"): 7}
    sync_partitions(spark, table, path, parquet_files(spark, path), drop=True)
    assert partition_changes(spark, table, parquet_files(spark, path)).isEmpty()


def test_schema_report_and_changes(spark):
    old = spark.sql("select 1 as id, 'a' as gone, 1 as n")
    new = spark.sql("select 2 as id, cast(1 as decimal(12,3)) as n, array(1) as added")
    assert [tuple(r) for r in schema_report(new).collect()] == [
        (1, "id", "int"),
        (2, "n", "decimal(12,3)"),
        (3, "added", "array<int>"),
    ]
    assert [tuple(r) for r in schema_changes(spark, old.schema, new.schema).collect()] == [
        ("id", "int", "int", "same"),
        ("gone", "string", None, "missing"),
        ("n", "int", "decimal(12,3)", "retyped"),
        ("added", None, "array<int>", "added"),
    ]
