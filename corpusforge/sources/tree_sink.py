"""A sink that writes rows as files of a tree: tasks write beside it, and what tasks have committed takes its place at the end."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    folder: str
    n: int


class FileTree(DataSource):
    """Writes rows (path, content) below the option path, a folder that the driver and all executors mount.

    Each attempt of a task has a folder of its own. On commit the files of committed attempts are moved to their places, one
    rename each; what failed or killed attempts have left goes away with the folder of the job. A path is relative, without
    empty, dot or dot-dot parts; of rows with one path the last that is moved stays. No content passes the driver.
    """

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _TreeWriter(self.options["path"].removeprefix("file://"))


class _TreeWriter(DataSourceWriter):
    def __init__(self, out: str):
        self.out = out
        self.beside = f"{out.rstrip('/')}.{uuid.uuid4().hex}.part"
        os.makedirs(self.beside)

    def write(self, rows: Iterator) -> Written:
        attempt, n = Path(self.beside) / uuid.uuid4().hex, 0
        attempt.mkdir()  # here and below without parents: a task that outlives its job finds no folder and ends
        for row in rows:
            parts = (row["path"] or "").split("/")
            if {"", ".", ".."} & set(parts) or "\0" in row["path"]:
                raise ValueError(f"not a path in the tree: {row['path']!r}")
            place = attempt
            for part in parts[:-1]:
                place = place / part
                place.mkdir(exist_ok=True)
            (place / parts[-1]).write_bytes(row["content"] if row["content"] is not None else b"")
            n += 1
        return Written(str(attempt), n)

    def commit(self, messages: list[Written | None]) -> None:
        for message in messages:
            if message is None or not message.n:
                continue
            for folder, _, names in os.walk(message.folder):
                place = Path(self.out) / Path(folder).relative_to(message.folder)
                place.mkdir(parents=True, exist_ok=True)
                for name in names:
                    os.replace(os.path.join(folder, name), place / name)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Take the job's folder away, by another name first, so that no task writes to it any more."""
        os.rename(self.beside, f"{self.beside}.gone")
        shutil.rmtree(f"{self.beside}.gone", ignore_errors=True)


def write_files(files: DataFrame, out: str) -> None:
    """Rows of files (path, content) as a tree below out."""
    spark = files.sparkSession
    spark.dataSource.register(FileTree)
    files.select("path", files["content"].cast("binary")).write.format("file_tree").mode("append").option("path", out).save()
