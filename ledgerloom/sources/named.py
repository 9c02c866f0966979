"""A data source that writes each row as a file of its own, under the name the row gives."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ledgerloom.shipping import ship
from ledgerloom.sources.shared import STAGING, opened

ship(__name__)

#: Written once all tasks of a run have ended well: from then on the run's files count, whatever happens to the driver.
MARK = "_committed"
MOVERS, AT_ONCE = 16, 256
TASKS = 16


class NamedFiles(DataSource):
    """``df.write.format("ledgerloom_files").mode("append").option("path", folder).save()`` for rows of ``name`` and ``content``.

    Tasks write whole files in a staging folder, one for each attempt. Only once all have ended well are the files of
    the attempts that won moved to their names, over older files of these names; others are left as they are. A run that
    fails or is killed before leaves nothing that has its final name, and one killed while it moves files is finished by
    the next run. The driver hears of folders, not of files.
    """

    @classmethod
    def name(cls) -> str:
        return "ledgerloom_files"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("only mode append: files of other names stay, those of the same name are replaced")
        root = self.options.get("path")
        if not root:
            raise ValueError("give the folder as option path")
        recover(root)
        return _Writer(root, schema.names.index("name"), schema.names.index("content"))


@dataclass
class _Folder(WriterCommitMessage):
    path: str


class _Writer(DataSourceWriter):
    def __init__(self, root: str, name: int, content: int):
        self.root, self.name, self.content, self.run = root, name, content, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        fs, top = opened(self.root)
        task = TaskContext.get()
        folder = f"{top}/{STAGING}/{self.run}/{task.partitionId()}-{task.taskAttemptId()}"
        fs.create_dir(folder, recursive=True)
        seen = set()
        for row in rows:
            name = row[self.name]
            if not name or "/" in name or name[0] in "._":
                raise ValueError(f"not a name for a file: {name!r}")
            if name in seen:
                raise ValueError(f"two rows have the name {name!r}")
            seen.add(name)
            with fs.open_output_stream(f"{folder}/{name}") as out:
                out.write((row[self.content] or "").encode("utf-8"))
        return _Folder(folder)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, top = opened(self.root)
        at = f"{top}/{STAGING}/{self.run}"
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/{MARK}.part") as out:
            out.write(json.dumps([m.path for m in messages if m]).encode())
        fs.move(f"{at}/{MARK}.part", f"{at}/{MARK}")
        _finish(fs, top, at)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, top = opened(self.root)
        at = f"{top}/{STAGING}/{self.run}"
        if fs.get_file_info(at).type == pafs.FileType.Directory:
            fs.delete_dir(at)


def _finish(fs: pafs.FileSystem, top: str, at: str) -> None:
    with fs.open_input_stream(f"{at}/{MARK}") as f:
        folders = json.loads(f.read())

    def place(files: list[pafs.FileInfo]) -> None:
        for f in files:
            fs.move(f.path, f"{top}/{f.base_name}")

    with ThreadPoolExecutor(MOVERS) as movers:
        for folder in folders:
            files = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
            list(movers.map(place, (files[i : i + AT_ONCE] for i in range(0, len(files), AT_ONCE))))
    fs.delete_dir(at)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """``(name, content)`` of the files there, each read once and whole; Spark's readers pass over empty ones.

    Spark deals a task some 32 small files, which are too few for what a task costs; here ``TASKS`` a core share them at most.
    """
    back = spark.read.format("binaryFile").load(root).coalesce(TASKS * spark.sparkContext.defaultParallelism)
    return back.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").cast("string").alias("content"))


def recover(root: str) -> None:
    """Finish runs that were committed but killed before all their files had their names."""
    fs, top = opened(root)
    for run in fs.get_file_info(pafs.FileSelector(f"{top}/{STAGING}", allow_not_found=True)):
        if fs.get_file_info(f"{run.path}/{MARK}").type == pafs.FileType.File:
            _finish(fs, top, run.path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NamedFiles)
