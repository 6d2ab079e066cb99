"""Parquet folders whose files differ in the types of their columns, as one table.

The footers are read in tasks and merged by an aggregate: one row per distinct
schema comes back. Files that Spark's reader can take as the merged type go
together; those it cannot (a bigint where the merged type is double) go into
groups by their own types. Each group is an external table over its folders,
and the table itself a view that casts and unites them, so filters, columns
and folders are still pruned in the scans.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from ledgerloom.session import ship_package
from ledgerloom.sources.files import read_directory

FOLDER = "_folder"
# Where Spark's writer keeps its own schema in a footer, and the folder name of a null.
_SPARK_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"
_NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"
_ADDED_AT_ONCE = 100

# Types that a file's column may be read as, beside its own.
READABLE = {
    "tinyint": ("smallint", "int", "bigint", "double"),
    "smallint": ("int", "bigint", "double"),
    "int": ("bigint", "double"),
    "float": ("double",),
    "date": ("timestamp_ntz",),
}
_DECIMAL = re.compile(r"decimal\((\d+),(\d+)\)\Z")
_WHOLE_DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 20}

# Types that a cast brings two others to, first match.
_CAST_TO = (
    ("double", {*_WHOLE_DIGITS, "float", "double"}),
    ("timestamp", {"date", "timestamp_ntz", "timestamp"}),
)


def _decimal_of(one: str, two: str) -> str | None:
    """The decimal that holds the values of two decimals, or of one and a whole type; None beyond 38 digits."""
    sizes = []
    for kind in (one, two):
        if found := _DECIMAL.match(kind):
            sizes.append((int(found[1]) - int(found[2]), int(found[2])))
        elif kind in _WHOLE_DIGITS:
            sizes.append((_WHOLE_DIGITS[kind], 0))
        else:
            return None
    whole, scale = (max(s) for s in zip(*sizes))
    return f"decimal({whole + scale},{scale})" if whole + scale <= 38 else None


def wider_type(one: str, two: str) -> str:
    """The type that values of both types can have without changing what they say.

    Where Spark's reader can take both as one type that type; else the type of a
    cast: decimals that hold both, double for numbers, timestamp for dates, and
    string for anything else. Of nested types that differ, the later one.
    """
    if one == two or "<" in one + two:
        return two
    for kind in (one, two, *READABLE.get(one, ())):
        if all(readable(t, kind) for t in (one, two)):
            return kind
    if both := _decimal_of(one, two):
        return both
    decimal = any(_DECIMAL.match(t) for t in (one, two))
    for kind, members in _CAST_TO:
        floats = {one, two} & {"float", "double"}
        if {one, two} <= members or (decimal and kind == "double" and floats):
            return kind
    return "string"


def readable(own: str, wanted: str) -> bool:
    """Whether Spark's Parquet reader takes a file's column of one type as the other."""
    return own == wanted or wanted in READABLE.get(own, ()) or "<" in own + wanted


def merged_schema(schemas: Iterable[T.StructType]) -> T.StructType:
    """The columns of all schemas in the order they come, each in the wider of its types."""
    types: dict[str, str] = {}
    for schema in schemas:
        for field in schema:
            kind = field.dataType.simpleString()
            types[field.name] = wider_type(types[field.name], kind) if field.name in types else kind
    return T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, k in types.items()])


# Folders


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark names files below it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def parquet_files(spark: SparkSession, path: str) -> DataFrame:
    """path, folder (relative to the given path, '' for itself) of the Parquet files below a path."""
    root = qualified(spark, path).rstrip("/")
    inside = F.substring("path", F.lit(len(root) + 2), F.length("path"))
    folder = F.regexp_replace(inside, r"(^|/)[^/]*$", "").alias("folder")
    return read_directory(spark, path, "*.parquet").select("path", folder)


def folder_value(folder: Column, name: str) -> Column:
    """The value that a relative folder name=value/... gives a partition column."""
    text = F.regexp_extract(folder, f"(?:^|/){re.escape(name)}=([^/]*)", 1)
    value = F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)
    return F.nullif(value, F.lit(_NULL_FOLDER))


def _partition_types(folders: DataFrame) -> T.StructType:
    """The partition columns of folders, each in the narrowest of int, bigint, double, date and string for all values."""
    parts = F.filter(F.split("folder", "/"), lambda p: p.contains("="))
    names = [r[0] for r in folders.select(F.explode(F.transform(parts, lambda p: F.substring_index(p, "=", 1)))).distinct().collect()]
    first = folders.where(F.size(parts) == len(names)).select(F.transform(parts, lambda p: F.substring_index(p, "=", 1))).first()
    fields = []
    for name in first[0] if first else sorted(names):
        value = folder_value(F.col("folder"), name)
        fits = folders.select(*(F.bool_and(value.isNull() | value.try_cast(t).isNotNull()).alias(t) for t in ("int", "bigint", "double", "date"))).first()
        fields.append(T.StructField(name, T._parse_datatype_string(next((t for t, ok in fits.asDict().items() if ok), "string"))))
    return T.StructType(fields)


# Footers


def _open(path: str):
    """A file of any file system Arrow knows, for reading."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, inside = fs.FileSystem.from_uri(quote(path, safe=":/"))
    return system.open_input_file(inside)


def footer_schema(path: str) -> T.StructType:
    """The columns of one file: as Spark wrote them down, or else from their Parquet types."""
    with _open(path) as source:
        arrow = pq.read_schema(source)
    written = (arrow.metadata or {}).get(_SPARK_SCHEMA)
    if written:
        return T.StructType.fromJson(json.loads(written))
    return T.StructType([T.StructField(f.name, from_arrow_type(f.type)) for f in arrow])


def _footers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shapes = [json.dumps([(f.name, f.dataType.simpleString()) for f in footer_schema(p.as_py())]) for p in batch.column(0)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shapes, pa.string())], ["path", "folder", "shape"])


def file_shapes(spark: SparkSession, path: str) -> DataFrame:
    """path, folder, shape (JSON of names and types) of every Parquet file; footers are read in tasks."""
    ship_package(spark)
    return parquet_files(spark, path).mapInArrow(_footers, "path string, folder string, shape string")


def _from_shape(shape: str) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in json.loads(shape)])


@dataclass(frozen=True)
class Evolution:
    """The merged columns, the partition columns, the columns of each group of files, and the group of each folder."""

    schema: T.StructType
    partitions: T.StructType
    groups: dict[str, T.StructType]
    folders: DataFrame


def _group(schema: T.StructType, merged: T.StructType) -> tuple[str, T.StructType]:
    """The name of the group a file belongs to, and the columns the group is read with."""
    own = {f.name: f.dataType.simpleString() for f in schema}
    odd = {n: t for n, t in own.items() if not readable(t, merged[n].dataType.simpleString())}
    fields = [T.StructField(f.name, T._parse_datatype_string(odd[f.name]) if f.name in odd else f.dataType) for f in merged]
    name = hashlib.md5(json.dumps(sorted(odd.items())).encode()).hexdigest()[:8] if odd else "0"
    return name, T.StructType(fields)


def discover(spark: SparkSession, path: str) -> Evolution:
    """Merge the schemas of all files below a path and sort its folders into groups.

    Back to the driver comes a row per distinct schema. Files of one folder may
    differ in their columns and in types that the reader brings together; where
    they need different casts, that is an error.
    """
    shapes = file_shapes(spark, path).persist()
    try:
        distinct = shapes.groupBy("shape").agg(F.min("path").alias("first")).orderBy("first").collect()
        merged = merged_schema(_from_shape(r["shape"]) for r in distinct)
        of_shape = {r["shape"]: _group(_from_shape(r["shape"]), merged) for r in distinct}
        named = spark.createDataFrame([(s, g) for s, (g, _) in of_shape.items()], "shape string, part string")
        folders = shapes.join(F.broadcast(named), "shape").groupBy("folder").agg(
            F.min("part").alias("part"), F.max("part").alias("last")
        )
        mixed = folders.where("part <> last").first()
        if mixed:
            raise ValueError(f"files in {path}/{mixed['folder']} need different casts: give each kind a folder")
        placed = folders.select("folder", "part")
        return Evolution(merged, _partition_types(placed), dict(of_shape.values()), placed)
    finally:
        shapes.unpersist()


# Partitions of a table in the catalog


def sql_name(*parts: str) -> str:
    return ".".join(f"`{p.replace('`', '``')}`" for p in parts)


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _is_by_folder(spark: SparkSession, table: str) -> bool:
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition] == [FOLDER]


def _known_folders(spark: SparkSession, table: str) -> DataFrame:
    """folder of every partition the catalog knows, as it is called below the table's path."""
    shown = spark.sql(f"SHOW PARTITIONS {sql_name(*table.split('.', 1))}")
    folder = F.col("partition")
    if _is_by_folder(spark, table):
        folder = F.coalesce(folder_value(folder, FOLDER), F.lit(""))
    return shown.select(folder.alias("folder"))


def partition_changes(spark: SparkSession, table: str, folders: DataFrame) -> DataFrame:
    """change (added, vanished) and folder: what lies in `folders` (folder) but not in the catalog, and the reverse."""
    known, found = _known_folders(spark, table), folders.select("folder").distinct()
    added = found.join(known, "folder", "left_anti").select(F.lit("added").alias("change"), "folder")
    return added.unionAll(known.join(found, "folder", "left_anti").select(F.lit("vanished"), "folder"))


def sync_partitions(spark: SparkSession, table: str, path: str, folders: DataFrame, drop: bool = False) -> DataFrame:
    """Tell the catalog of new folders below a path, and with `drop` of those that are gone; what was found.

    Only folders that the catalog does not know are touched. They pass the
    driver one by one and are added a hundred at a time.
    """
    changes = partition_changes(spark, table, folders)
    of_folder = _is_by_folder(spark, table)

    def spec(folder: str) -> str:
        if of_folder:
            return f"{sql_name(FOLDER)} = {sql_text(folder)}"
        pairs = [p.split("=", 1) for p in folder.split("/") if "=" in p]
        return ", ".join(f"{sql_name(n)} = {'NULL' if v == _NULL_FOLDER else sql_text(unquote(v))}" for n, v in pairs)

    def alter(verb: str, parts: list[str]) -> None:
        if parts:
            spark.sql(f"ALTER TABLE {sql_name(*table.split('.', 1))} {verb} {' '.join(parts)}")

    waiting: list[str] = []
    for row in changes.where("change = 'added'").sort("folder").toLocalIterator():
        at = f"{path.rstrip('/')}/{row['folder']}" if row["folder"] else path
        waiting.append(f"PARTITION ({spec(row['folder'])}) LOCATION {sql_text(at)}")
        if len(waiting) == _ADDED_AT_ONCE:
            alter("ADD IF NOT EXISTS", waiting)
            waiting = []
    alter("ADD IF NOT EXISTS", waiting)
    if drop:
        for row in changes.where("change = 'vanished'").sort("folder").toLocalIterator():
            alter("DROP IF EXISTS", [f"PARTITION ({spec(row['folder'])})"])
    return changes


# Tables of several groups


def _same_columns(a: T.StructType, b: T.StructType) -> bool:
    return [(f.name, f.dataType) for f in a] == [(f.name, f.dataType) for f in b]


def _group_table(spark: SparkSession, table: str, path: str, part: str, columns: T.StructType) -> str:
    """The external table of one group of folders, made anew where its columns have changed."""
    name = f"{table}__files_{part}"
    wanted = T.StructType([*columns.fields, T.StructField(FOLDER, T.StringType())])
    if spark.catalog.tableExists(name):
        if _same_columns(spark.table(name).schema, wanted):
            return name
        spark.sql(f"DROP TABLE {sql_name(*name.split('.', 1))}")  # its files stay
    shown = ", ".join(f"{sql_name(f.name)} {f.dataType.simpleString()}" for f in wanted)
    spark.sql(
        f"CREATE TABLE {sql_name(*name.split('.', 1))} ({shown}) USING parquet "
        f"PARTITIONED BY ({sql_name(FOLDER)}) LOCATION {sql_text(path)}"
    )
    return name


def _folder_sql(field: T.StructField) -> str:
    text = f"regexp_extract({FOLDER}, {sql_text('(?:^|/)' + re.escape(field.name) + '=([^/]*)')}, 1)"
    value = f"nullif(coalesce(try_url_decode(replace({text}, '+', '%2B')), {text}), '{_NULL_FOLDER}')"
    return f"CAST({value} AS {field.dataType.simpleString()}) AS {sql_name(field.name)}"


def register_groups(spark: SparkSession, table: str, path: str, evolution: Evolution) -> None:
    """Make `table` a view that unites the groups of a path's files, each cast to the merged types.

    The catalog learns of the folders that are new in each group and forgets
    those that are gone.
    """
    selects = []
    for part, columns in sorted(evolution.groups.items()):
        name = _group_table(spark, table, path, part, columns)
        sync_partitions(spark, name, path, evolution.folders.where(F.col("part") == part), drop=True)
        cells = [f"CAST({sql_name(f.name)} AS {f.dataType.simpleString()}) AS {sql_name(f.name)}" for f in evolution.schema]
        cells += [_folder_sql(f) for f in evolution.partitions]
        selects.append(f"SELECT {', '.join(cells)} FROM {sql_name(*name.split('.', 1))}")
    spark.sql(f"CREATE OR REPLACE VIEW {sql_name(*table.split('.', 1))} AS {' UNION ALL '.join(selects)}")
