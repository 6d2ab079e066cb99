"""A keyed table in hash buckets, where the last write of a key wins.

    rows/<run>/bucket=<b>/part-*.parquet    the rows of one write, or of several merged
    versions/<n>.json                       which runs make up each bucket in version n

A batch adds one run with its newest row per key. A bucket that has FAN runs
of one level gets one of the next level in their place, so a row is rewritten
once per level and buckets that did not change are not touched. A version comes
into being by the rename of its file, which fails if there is one: a reader
sees one version or the next, and of two writers one is refused. Runs that the
last versions no longer name are removed.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.ranking import latest_per_key

BUCKETS = 64
FAN = 4
# Versions whose runs stay, for readers that began with them.
KEPT_VERSIONS = 10
_BATCH, _BUCKET = "_batch", "bucket"


class ConcurrentWriteError(RuntimeError):
    """Another writer made the version that was to be made."""


@dataclass(frozen=True)
class Run:
    """A folder of rows of some buckets; the level counts the merges it went through."""

    name: str
    level: int = 0


@dataclass(frozen=True)
class Version:
    """What a reader needs: the runs of each bucket, and the last batch put."""

    number: int = 0
    last_batch: int = -1
    schema: str = ""
    runs: dict[int, tuple[Run, ...]] = field(default_factory=dict)

    def names(self) -> set[str]:
        return {run.name for runs in self.runs.values() for run in runs}

    def as_json(self) -> str:
        runs = {str(b): [[r.name, r.level] for r in held] for b, held in sorted(self.runs.items())}
        return json.dumps({"last_batch": self.last_batch, "schema": self.schema, "runs": runs})

    @classmethod
    def from_json(cls, number: int, text: str) -> Version:
        found = json.loads(text)
        runs = {int(b): tuple(Run(*r) for r in held) for b, held in found["runs"].items()}
        return cls(number, found["last_batch"], found["schema"], runs)


class _Folder:
    """Small files and folders of a path, through the file system that Spark uses for it."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        self._files = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._files.listStatus(at)) if self._files.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._files.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file whole under its name; False if the name is taken."""
        hidden = self._at(f"{name.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
        stream = self._files.create(hidden, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(hidden.toUri(), self._conf)
        options = self._jvm.java.lang.reflect.Array.newInstance(
            self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0
        )
        try:
            context.rename(self._files.makeQualified(hidden), self._files.makeQualified(self._at(name)), options)
        except Exception as error:
            self._files.delete(hidden, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True

    def remove(self, name: str) -> None:
        self._files.delete(self._at(name), True)


def _version_file(number: int) -> str:
    return f"versions/{number:012d}.json"


@dataclass(frozen=True)
class KeyedTable:
    """The table at `path`, one row per `keys`: that of the last batch, and in it of the largest `seq`.

    Keys may be null. `buckets` is chosen once for a table: a task resolves a
    bucket at a time, so a bucket's rows should fit one (a terabyte in 4096
    buckets is 256 MB each). The columns follow the batches; those a batch lacks
    are null in its rows.
    """

    path: str
    keys: tuple[str, ...]
    seq: str
    buckets: int = BUCKETS
    fan: int = FAN
    kept_versions: int = KEPT_VERSIONS

    def _folder(self, spark: SparkSession) -> _Folder:
        return _Folder(spark, self.path)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    # Versions

    def _numbers(self, folder: _Folder) -> list[int]:
        return [int(name[: -len(".json")]) for name in folder.names("versions") if name.endswith(".json") and name[0] != "."]

    def version(self, spark: SparkSession) -> Version:
        """The newest version; an empty one where nothing was put."""
        folder = self._folder(spark)
        numbers = self._numbers(folder)
        return Version.from_json(numbers[-1], folder.read(_version_file(numbers[-1]))) if numbers else Version()

    def _commit(self, spark: SparkSession, version: Version) -> Version:
        if not self._folder(spark).create(_version_file(version.number), version.as_json()):
            raise ConcurrentWriteError(f"version {version.number} of {self.path} was made by another writer")
        return version

    # Rows

    def _runs(self, spark: SparkSession, version: Version, wanted: dict[int, Sequence[Run]]) -> DataFrame:
        """All rows that the wanted runs hold for their buckets, with _batch and bucket."""
        schema = T.StructType.fromJson(json.loads(version.schema))
        paths = [f"{self.path.rstrip('/')}/rows/{run.name}/{_BUCKET}={b}" for b, runs in sorted(wanted.items()) for run in runs]
        if not paths:
            return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(_BUCKET, T.IntegerType())]))
        rows = spark.read.schema(schema).parquet(*paths)
        return rows.withColumn(_BUCKET, F.regexp_extract("_metadata.file_path", rf"/{_BUCKET}=(\d+)/[^/]*$", 1).cast("int"))

    def _resolved(self, rows: DataFrame) -> DataFrame:
        return latest_per_key(rows, (_BUCKET, *self.keys), [_BATCH, self.seq])

    def rows(self, spark: SparkSession, version: Version | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows of a version, the newest unless told otherwise; `only` names buckets to read.

        Buckets of one run have one row per key already and are not aggregated.
        """
        version = version or self.version(spark)
        if not version.schema:
            raise ValueError(f"nothing was put into {self.path}")
        chosen = {b: runs for b, runs in version.runs.items() if only is None or b in only}
        alone = {b: runs for b, runs in chosen.items() if len(runs) == 1}
        several = {b: runs for b, runs in chosen.items() if len(runs) > 1}
        parts = [self._runs(spark, version, alone)] if alone or not several else []
        parts += [self._resolved(self._runs(spark, version, several))] if several else []
        whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return whole.drop(_BATCH, _BUCKET)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The rows whose keys `wanted` has; only their buckets are read."""
        spark = wanted.sparkSession
        keys = wanted.select(*self.keys).distinct()
        only = {row[0] for row in keys.select(self.bucket()).distinct().collect()}  # at most `buckets` numbers
        found = self.rows(spark, only=only)
        same = [found[k].eqNullSafe(keys[k]) for k in self.keys]
        return found.join(keys, same, "left_semi")

    # Writes

    def _write(self, rows: DataFrame, name: str) -> set[int]:
        """Write rows (with bucket) as one run, a file per bucket; the buckets it has."""
        spark = rows.sparkSession
        rows.repartition(self.buckets, _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path.rstrip('/')}/rows/{name}")
        return {int(n.split("=")[1]) for n in self._folder(spark).names(f"rows/{name}") if n.startswith(f"{_BUCKET}=")}

    def put(self, df: DataFrame, batch_id: int) -> Version:
        """Add the newest rows of one batch. Batches come in order; one that was put is not put again."""
        spark = df.sparkSession
        before = self.version(spark)
        if batch_id <= before.last_batch:
            return before
        newest = latest_per_key(df, self.keys, [self.seq]).withColumn(_BATCH, F.lit(batch_id).cast("bigint"))
        name = f"{before.number + 1:012d}-{uuid.uuid4().hex}"
        touched = self._write(newest.withColumn(_BUCKET, self.bucket()), name)
        runs = dict(before.runs)
        for b in touched:
            runs[b] = (*runs.get(b, ()), Run(name))
        schema = _merged_schema(before.schema, newest.schema)
        version = self._commit(spark, Version(before.number + 1, batch_id, schema, runs))
        return self._merge_full_levels(spark, version)

    def _merge_full_levels(self, spark: SparkSession, version: Version) -> Version:
        while due := dict(_full_levels(version.runs, self.fan)):
            version = self._merged(spark, version, due)
        return version

    def _merged(self, spark: SparkSession, version: Version, due: dict[int, tuple[Run, ...]]) -> Version:
        """The version in which each bucket of `due` has one run in place of those given."""
        name = f"{version.number + 1:012d}-{uuid.uuid4().hex}"
        self._write(self._resolved(self._runs(spark, version, due)), name)
        runs = dict(version.runs)
        for b, old in due.items():
            level = max(run.level for run in old) + 1
            runs[b] = tuple(r for r in (Run(name, level), *(run for run in runs[b] if run not in old)))
        return self._commit(spark, Version(version.number + 1, version.last_batch, version.schema, runs))

    def merge(self, spark: SparkSession) -> Version:
        """Give every bucket one run; buckets that have one are not touched."""
        version = self.version(spark)
        due = {b: runs for b, runs in version.runs.items() if len(runs) > 1}
        return self._merged(spark, version, due) if due else version

    def vacuum(self, spark: SparkSession) -> list[str]:
        """Remove the runs that none of the last versions names, and older versions; the names of the runs.

        For the writer between its writes: a run that is being written has no version yet.
        """
        folder = self._folder(spark)
        numbers = self._numbers(folder)
        kept = set()
        for number in numbers[-self.kept_versions :]:
            kept |= Version.from_json(number, folder.read(_version_file(number))).names()
        for number in numbers[: -self.kept_versions]:
            folder.remove(_version_file(number))
        gone = [name for name in folder.names("rows") if name not in kept]
        for name in gone:
            folder.remove(f"rows/{name}")
        return gone


def _merged_schema(old: str, new: T.StructType) -> str:
    """The columns of both, nullable; a column keeps its type."""
    fields = list(T.StructType.fromJson(json.loads(old)).fields) if old else []
    known = {f.name: f.dataType for f in fields}
    for f in new:
        if f.name not in known:
            fields.append(T.StructField(f.name, f.dataType))
        elif known[f.name] != f.dataType:
            raise ValueError(f"{f.name} is {known[f.name].simpleString()} in the table and {f.dataType.simpleString()} in the batch")
    return T.StructType([T.StructField(f.name, f.dataType) for f in fields]).json()


def _full_levels(runs: dict[int, tuple[Run, ...]], fan: int) -> Iterator[tuple[int, tuple[Run, ...]]]:
    """Buckets with `fan` runs of one level, with these; of several such levels the lowest."""
    for b, held in runs.items():
        levels = defaultdict(list)
        for run in held:
            levels[run.level].append(run)
        full = [level for level, of_level in levels.items() if len(of_level) >= fan]
        if full:
            yield b, tuple(levels[min(full)])


def upsert_stream(
    arrivals: DataFrame,
    table: KeyedTable,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] = lambda batch: batch,
    output_mode: str = "append",
) -> StreamingQuery:
    """Put all items that have arrived into the table and stop.

    `prepare` turns the rows of a batch into the items to put. Runs that are no
    longer needed are removed after each batch.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        table.put(prepare(batch), batch_id)
        table.vacuum(batch.sparkSession)

    return (
        arrivals.writeStream.foreachBatch(put)
        .outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
