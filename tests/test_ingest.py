import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.money import two_decimals
from ledgerloom.operators.filters import current_period
from ledgerloom.plans import ingest
from ledgerloom.sinks.files import dataset_name, dataset_path, decoded_key, write_csv, write_matrix, write_parquet
from ledgerloom.sources.files import infer_csv_schema, read_csv, read_directory

WHEN = dt.datetime(2025, 5, 3, 1, 2, 3)


def _put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(folder)


def test_csv_to_parquet_types_counts_and_path(spark, tmp_path):
    source = _put(tmp_path / "in.v1", "a.csv", "id,amount,day,ok,name\n1,2.5,2025-05-01,true,x\n2,3,2025-05-02,false,\n")
    done = ingest.csv_to_parquet(spark, source, str(tmp_path / "out"), WHEN)
    assert done.path == f"{tmp_path}/out/data/in_20250503010203"
    assert done.rows == 2
    stored = spark.read.parquet(done.path)
    assert [f.dataType.simpleString() for f in stored.schema] == ["int", "double", "date", "boolean", "string"]
    assert sorted(tuple(r) for r in stored.collect()) == [
        (1, 2.5, dt.date(2025, 5, 1), True, "x"),
        (2, 3.0, dt.date(2025, 5, 2), False, None),
    ]


def test_quotes_escapes_and_subfolders(spark, tmp_path):
    folder = tmp_path / "in"
    _put(folder, "a.csv", 'id,text\n1,"a, \\"b\\""\n')
    _put(folder, "deep/er/b.csv", 'id,text\n2,"c"\n')
    assert sorted(tuple(r) for r in read_csv(spark, str(folder)).collect()) == [(1, 'a, "b"'), (2, "c")]
    semi = _put(tmp_path / "semi", "a.csv", "id;text\n1;'x;y'\n")
    assert [tuple(r) for r in read_csv(spark, semi, sep=";", quote="'").collect()] == [(1, "x;y")]


def test_misfits_are_kept_whole(spark, tmp_path):
    source = _put(tmp_path / "in", "a.csv", "id,n\n1,2\n2,many\n3,4,5\n")
    schema = T.StructType().add("id", "integer").add("n", "integer")
    done = ingest.csv_to_parquet(spark, source, str(tmp_path / "out"), WHEN, schema, corrupt_column=True)
    stored = {r["id"]: r["_corrupt_record"] for r in spark.read.parquet(done.path).collect()}
    assert stored == {1: None, 2: "2,many", 3: "3,4,5"}


def test_empty_input_is_an_error(spark, tmp_path):
    source = _put(tmp_path / "in", "a.csv", "id,n\n")
    with pytest.raises(ingest.EmptyInputError):
        ingest.csv_to_parquet(spark, source, str(tmp_path / "out"), WHEN)
    assert not (tmp_path / "out").exists()


def test_the_same_second_does_not_overwrite(spark, tmp_path):
    source = _put(tmp_path / "in", "a.csv", "id\n1\n")
    ingest.csv_to_parquet(spark, source, str(tmp_path / "out"), WHEN)
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        ingest.csv_to_parquet(spark, source, str(tmp_path / "out"), WHEN)


def test_convert_and_register(spark, tmp_path):
    source = _put(tmp_path / "sales", "a.csv", "id\n1\n2\n")
    table = ingest.convert_and_register(spark, source, str(tmp_path / "out"), WHEN, "ingest_db", "demo_")
    assert table == "ingest_db.demo_sales_20250503010203"
    assert spark.table(table).count() == 2


def test_apply_mapping_is_positional(spark):
    df = spark.sql("select 1 as a, '2' as b")
    mapped = ingest.apply_mapping(df, ["x", "y z"], ["string", "int"])
    assert mapped.dtypes == [("x", "string"), ("y z", "int")]
    assert tuple(mapped.first()) == ("1", 2)
    assert ingest.apply_mapping(df, ["b", "a"]).dtypes == [("b", "int"), ("a", "string")]
    with pytest.raises(ValueError):
        ingest.apply_mapping(df, ["x"])


def test_dataset_names(spark):
    keys = [("in/my+file%28a%29.v1.csv", "my file(a)"), ("plain", "plain"), ("x/100%.csv", "100%"), ("a/.csv", "")]
    df = spark.createDataFrame(keys, "key string, stem string")
    for when in (WHEN, F.lit(WHEN)):
        name = dataset_name(decoded_key(F.col("key")), when)
        for row in df.select("stem", name.alias("name")).collect():
            assert row["name"] == f"{row['stem']}_20250503010203"
    assert dataset_path("s3://b/", "in/x.y.csv", WHEN) == "s3://b/data/x_20250503010203"


def test_retyping_promotes_only_whole_columns(spark):
    rows = [
        ("1", "1", "1.5", "1", "", "01", "9223372036854775808", "1e5", None),
        ("", "x", "2", "2.5", "", "-3", "1", "1.5", "7"),
    ]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, g string, h string, i string")
    typed = ingest.retype_strings(df)
    assert [t for _, t in typed.dtypes] == [
        "bigint", "string", "double", "double", "string", "bigint", "string", "string", "bigint",
    ]
    assert [tuple(r) for r in typed.collect()] == [
        (1, "1", 1.5, 1.0, "", 1, "9223372036854775808", "1e5", None),
        (None, "x", 2.0, 2.5, "", -3, "1", "1.5", 7),
    ]


def test_retyping_in_one_scan(spark, tmp_path):
    """The same types and rows as in two passes, and each row of the source is read once."""
    rows = [("1", "x`y", "2.5", "", None), ("", "7", "3", "", "8"), ("-4", "", ".5", "", None)] * 50
    df = spark.createDataFrame(rows, ["a", "b c", "d", "e", "f"])
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    source = df.repartition(5).mapInArrow(counted, df.schema)
    typed, expected = ingest.retype_once(source, str(tmp_path / "once")), ingest.retype_strings(df)
    assert typed.dtypes == expected.dtypes == [("a", "bigint"), ("b c", "string"), ("d", "double"), ("e", "string"), ("f", "bigint")]
    assert sorted(map(str, typed.collect())) == sorted(map(str, expected.collect()))
    assert read.value == 150
    empty = ingest.retype_once(spark.read.schema(df.schema).csv(str(_folder(tmp_path))), str(tmp_path / "empty"))
    assert empty.isEmpty() and empty.dtypes == df.dtypes
    numbers = ingest.retype_once(spark.range(3), str(tmp_path / "numbers"))
    assert numbers.dtypes == [("id", "bigint")] and numbers.count() == 3


def _folder(tmp_path):
    path = tmp_path / "no files"
    path.mkdir()
    return path


def test_retyping_refuses_java_number_suffixes(spark):
    df = spark.createDataFrame([("1.5d", "1.5f", "NaN", "1.5e2", " 2.5 ")], "a string, b string, c string, d string, e string")
    assert tuple(ingest.retype_strings(df).first()) == ("1.5d", "1.5f", "NaN", 150.0, 2.5)


def test_csv_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c\\d'), (2, None)], "id int, text string")
    assert write_csv(df, str(tmp_path / "with"))
    assert sorted(tuple(r) for r in read_csv(spark, str(tmp_path / "with")).collect()) == [(1, 'a "b", c\\d'), (2, None)]
    assert not write_csv(df.where("id > 9"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    matrix = spark.createDataFrame([([1.0, 2.5],), ([3.0, 4.0],)], "features array<double>")
    write_matrix(matrix, "features", str(tmp_path / "matrix"), 2)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "matrix")).collect()) == ["1.0,2.5", "3.0,4.0"]


def test_parquet_sink_counts_while_writing(spark, tmp_path):
    assert write_parquet(spark.range(1000), str(tmp_path / "p")) == 1000


def test_directory_listing(spark, tmp_path):
    folder = tmp_path / "files"
    _put(folder, "a.bin", "xyz")
    _put(folder, "sub/b.bin", "x")
    _put(folder, "c.txt", "other")
    files = read_directory(spark, str(folder), "*.bin").select("length", "content").collect()
    assert sorted((r[0], bytes(r[1])) for r in files) == [(1, b"x"), (3, b"xyz")]


def test_two_decimals_and_current_period(spark):
    df = spark.sql("select cast(1.005 as decimal(10,3)) as a, cast(2 as bigint) as b, cast(null as double) as c")
    assert tuple(df.select(*[two_decimals(F.col(c)) for c in df.columns]).first()) == ("1.01", "2.00", None)
    month = spark.range(1).select(current_period()).first()[0]
    assert month.day == 1


def test_inference_reads_the_header(spark, tmp_path):
    source = _put(tmp_path / "in", "a.csv", "id,n\n1,99999999999\n")
    assert infer_csv_schema(spark, source).simpleString() == "struct<id:int,n:bigint>"
    assert ingest.first_rows(read_csv(spark, source)).count() == 1
