"""A Spark data source of whole binary files: a folder of them to rows (name, data) and back.

    spark.dataSource.register(Blobs)
    df.write.format("blobs").mode("append").save(folder)
    spark.read.format("blobs").load(folder)

The folder is one that all machines mount; for stores that only Spark reaches, read with Spark's binaryFile. A task writes its
files under names of its own, and the driver's commit gives them theirs, so that a task that is lost or runs twice leaves none.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "name string, data binary"
TASKS = "_tasks"


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # path for now, name


class Reader(DataSourceReader):
    def __init__(self, folder: str, per_task: int) -> None:
        self.folder, self.per_task = folder, per_task

    def partitions(self) -> list[Files]:
        names = sorted(n for n in os.listdir(self.folder) if not n.startswith(("_", ".")))
        paths = [os.path.join(self.folder, n) for n in names]
        return [Files(paths[k : k + self.per_task]) for k in range(0, len(paths), self.per_task)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple[str, bytes]]:
        for path in partition.paths:
            with open(path, "rb") as f:
                yield os.path.basename(path), f.read()


class Writer(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.overwrite = folder, overwrite

    def write(self, iterator: Iterator) -> Written:
        os.makedirs(os.path.join(self.folder, TASKS), exist_ok=True)
        files = []
        for row in iterator:
            if row.name is None or row.data is None or os.path.basename(row.name) != row.name or row.name.startswith(("_", ".")):
                raise ValueError(f"no file can be made of {row.name!r}")
            path = os.path.join(self.folder, TASKS, uuid.uuid4().hex)
            with open(path, "wb") as f:
                f.write(bytes(row.data))
            files.append((path, row.name))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        new = [f for m in messages if m for f in m.files]
        names = [name for _, name in new]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have one name")
        if self.overwrite and os.path.isdir(self.folder):
            for name in set(os.listdir(self.folder)) - set(names) - {TASKS}:
                os.remove(os.path.join(self.folder, name))
        for path, name in new:
            os.replace(path, os.path.join(self.folder, name))

    def abort(self, messages: list[Written | None]) -> None:
        for path, _ in (f for m in messages if m for f in m.files):
            if os.path.exists(path):
                os.remove(path)


class Blobs(DataSource):
    """Options: path, and filesPerTask (64) for reading."""

    @classmethod
    def name(cls) -> str:
        return "blobs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], int(self.options.get("filespertask", 64)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)
