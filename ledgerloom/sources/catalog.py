"""Tables over Parquet folders: registration by discovery and schema evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerloom.sources.evolution import (
    discover,
    merged_schema,
    parquet_files,
    register_groups,
    sql_name,
    sql_text,
    sync_partitions,
)
from ledgerloom.sources.files import read_merged_parquet

_REPORT_SCHEMA = "position int, name string, type string"
_CHANGES_SCHEMA = "name string, old_type string, new_type string, change string"


def _known_type(spark: SparkSession, table: str) -> str | None:
    """EXTERNAL, MANAGED or VIEW; None for a table that is not known."""
    return spark.catalog.getTable(table).tableType if spark.catalog.tableExists(table) else None


def _drop(spark: SparkSession, table: str) -> None:
    """Forget a table or view; files stay."""
    kind = "VIEW" if _known_type(spark, table) == "VIEW" else "TABLE"
    spark.sql(f"DROP {kind} IF EXISTS {sql_name(*table.split('.', 1))}")


def _one_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The columns and partitions of a path's files where Spark can merge them as they are, else None."""
    try:
        return read_merged_parquet(spark, path).schema
    except Exception as error:  # Spark raises this from a task, wrapped
        if "CANNOT_MERGE_SCHEMAS" not in str(error) and "Failed to merge" not in str(error):
            raise
    return None


def register_table(
    spark: SparkSession, path: str, database: str, prefix: str = "", name: str | None = None, location: str | None = None
) -> str:
    """Make a Parquet folder a table of the catalog and return its full name.

    The table is called {database}.{prefix}{folder} with the columns and
    partitions found under the path. A known table gets columns that are new and
    wider types where files have them; its columns that are no longer found
    stay. Files are not moved. Only folders that the catalog does not know are
    added to it; `partition_changes` tells which are gone.

    One pass over the footers finds the columns. Where types differ so that no
    reader brings them together, such as bigint and double, the table is a view
    over a table for each kind of files (see `evolution`).
    """
    name = name or path.rstrip("/").rsplit("/", 1)[-1]
    table = f"{database}.{prefix}{name}"
    at = f" LOCATION {sql_text(location)}" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {sql_name(database)}{at}")
    found, evolution = _one_schema(spark, path), None
    if found is None:
        evolution = discover(spark, path)
        found = T.StructType([*evolution.schema.fields, *evolution.partitions.fields])
    known = _known_type(spark, table)
    if evolution is not None and len(evolution.groups) > 1:
        if known and known != "VIEW":
            _drop(spark, table)
        register_groups(spark, table, path, evolution)
        return table
    if known == "VIEW":
        _drop(spark, table)
        known = None
    if known:
        _widen(spark, table, merged_schema([spark.table(table).schema, found]), path)
    else:
        _create(spark, table, found, path)
    if _is_partitioned(spark, table):
        sync_partitions(spark, table, path, parquet_files(spark, path).where("folder <> ''"))
        spark.catalog.refreshTable(table)
    return table


def _create(spark: SparkSession, table: str, schema: T.StructType, path: str) -> None:
    partitions = [f.name for f in schema if f"/{f.name}=" in _one_file(spark, path)]
    columns = ", ".join(f"{sql_name(f.name)} {f.dataType.simpleString()}" for f in schema)
    by = f" PARTITIONED BY ({', '.join(map(sql_name, partitions))})" if partitions else ""
    spark.sql(f"CREATE TABLE {sql_name(*table.split('.', 1))} ({columns}) USING parquet{by} LOCATION {sql_text(path)}")


def _one_file(spark: SparkSession, path: str) -> str:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
    first = files.load(path).select("path").first()
    return first["path"] if first else ""


def _widen(spark: SparkSession, table: str, wanted: T.StructType, path: str) -> None:
    """Give a table new columns, or, where types change, the same table anew over the same files."""
    known = spark.table(table).schema
    if all(f.name not in known.names or known[f.name].dataType == f.dataType for f in wanted):
        _add_columns(spark, table, wanted)
        spark.catalog.refreshTable(table)
    else:
        spark.sql(f"DROP TABLE {sql_name(*table.split('.', 1))}")  # an external table: files stay
        _create(spark, table, wanted, path)


def add_partition(spark: SparkSession, table: str, schema: T.StructType, column: str, value: int | str) -> None:
    """Tell a table of one new partition folder, without looking at the others.

    `schema` holds the columns of the new files; the table gets those it lacks.
    """
    _add_columns(spark, table, schema)
    literal = str(value) if isinstance(value, int) else sql_text(value)
    spark.sql(f"ALTER TABLE {sql_name(*table.split('.', 1))} ADD IF NOT EXISTS PARTITION ({sql_name(column)} = {literal})")
    spark.catalog.refreshTable(table)


def _add_columns(spark: SparkSession, table: str, found: T.StructType) -> None:
    known = spark.table(table).schema.names
    added = [f"{sql_name(f.name)} {f.dataType.simpleString()}" for f in found if f.name not in known]
    if added:
        spark.sql(f"ALTER TABLE {sql_name(*table.split('.', 1))} ADD COLUMNS ({', '.join(added)})")


def _is_partitioned(spark: SparkSession, table: str) -> bool:
    return any(column.isPartition for column in spark.catalog.listColumns(table))


def schema_report(df: DataFrame) -> DataFrame:
    """The columns of a frame as rows (position, name, type), positions from 1."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema, start=1)]
    return df.sparkSession.createDataFrame(rows, _REPORT_SCHEMA)


def schema_changes(spark: SparkSession, old: T.StructType, new: T.StructType) -> DataFrame:
    """What a re-discovery found: columns added, missing or of another type."""
    rows = []
    for name in [*old.names, *[n for n in new.names if n not in old.names]]:
        before = old[name].dataType.simpleString() if name in old.names else None
        after = new[name].dataType.simpleString() if name in new.names else None
        if before is None:
            change = "added"
        elif after is None:
            change = "missing"
        else:
            change = "same" if before == after else "retyped"
        rows.append((name, before, after, change))
    return spark.createDataFrame(rows, _CHANGES_SCHEMA)
