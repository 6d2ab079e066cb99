"""Files with names of one's own, one per row, as a Spark data source.

Tasks write below a staging folder. Only when all have finished are their
folders moved to where readers look, one rename per task; a task or job that
fails leaves nothing there.
"""

from __future__ import annotations

import dataclasses
import uuid

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# Readers of folders leave names out that begin like this.
_STAGING = "_staging-"


@dataclasses.dataclass
class _TaskFolder(WriterCommitMessage):
    """The folder a task has written, null for one without rows."""

    folder: str | None


class _Writer(DataSourceWriter):
    def __init__(self, path: str, flat: bool, overwrite: bool):
        self.path, self.flat, self.overwrite = path.rstrip("/"), flat, overwrite
        self.job = uuid.uuid4().hex

    def _place(self) -> tuple[fs.FileSystem, str, str]:
        system, root = fs.FileSystem.from_uri(self.path)
        return system, root, f"{root}/{_STAGING}{self.job}"

    def write(self, rows) -> _TaskFolder:
        system, _, staging = self._place()
        folder, names = None, set()
        for row in rows:
            name = row["name"]
            if not name or "/" in name or name[0] in "._":
                raise ValueError(f"{name!r} is no name of a file")
            if name in names:
                raise ValueError(f"two rows are named {name!r}")
            names.add(name)
            if folder is None:
                context = TaskContext.get()
                folder = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{self.job}"
                system.create_dir(f"{staging}/{folder}")
            with system.open_output_stream(f"{staging}/{folder}/{name}") as out:
                out.write(bytes(row["content"] or b""))
        return _TaskFolder(folder)

    def commit(self, messages) -> None:
        system, root, staging = self._place()
        system.create_dir(root)
        before = [f for f in system.get_file_info(fs.FileSelector(root)) if not f.base_name.startswith(_STAGING)]
        if self.overwrite:
            for found in before:
                (system.delete_dir if found.type == fs.FileType.Directory else system.delete_file)(found.path)
        for message in messages:
            if message is None or message.folder is None:
                continue
            if not self.flat:
                system.move(f"{staging}/{message.folder}", f"{root}/{message.folder}")
                continue
            for found in system.get_file_info(fs.FileSelector(f"{staging}/{message.folder}")):
                system.move(found.path, f"{root}/{found.base_name}")
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        system, _, staging = self._place()
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)


class NamedFiles(DataSource):
    """The format `named_files`: rows (name, content) become files; options path and flat."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options.get("flat", "false") == "true", overwrite)


def write_named_files(
    df: DataFrame, name: Column, content: Column, path: str, mode: str = "append", flat: bool = False
) -> None:
    """One file per row, called `name`, with the bytes of `content` (null: none).

    The files lie in a folder per task below `path`, whatever their number. With
    `flat` they lie in `path` itself and take the place of files of their names;
    they are then moved one by one, so that is for some thousands. Modes are
    append and overwrite. A name that is empty, hidden or has a slash, and a name
    twice in one task, are errors. The path must be of a file system that Arrow
    can open (local, HDFS, S3 and others).
    """
    df.sparkSession.dataSource.register(NamedFiles)
    rows = df.select(name.cast("string").alias("name"), content.cast("binary").alias("content"))
    rows.write.format("named_files").mode(mode).option("flat", str(flat).lower()).save(path)
