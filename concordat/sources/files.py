"""``files``: rows written as files of a folder, all of a job's or none."""

from __future__ import annotations

import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .ship import ship

STAGING = ".staging-"


class FilesSink(DataSource):
    """A sink of rows (path string, content string): each becomes the file ``path`` below option path.

    The folder is one that all executors see.  A task writes into a folder of its own attempt, so what a
    failed or lost attempt wrote is never published; its message names the folder.  The commit first makes
    sure that no path is taken, there or by another task, and then moves the files, which needs no copy;
    readers see each file whole.  If a task fails for good, or a path is taken, nothing is left.
    Names of files pass through the driver, their content does not.
    """

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("files are only added")
        return _FilesWriter(self.options["path"].rstrip("/"))


@dataclass
class _Attempt(WriterCommitMessage):
    folder: str


class _FilesWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.staging = root, f"{root}/{STAGING}{uuid.uuid4().hex}"
        os.makedirs(self.staging)  # by the driver alone: once it is gone, no task can bring it back

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        folder = f"{self.staging}/{uuid.uuid4().hex}"
        os.mkdir(folder)
        for row in iterator:
            if not row.path or any(p in ("", ".", "..") for p in row.path.split("/")):
                raise ValueError(f"not a path below the folder: {row.path!r}")
            where, at = f"{folder}/{row.path}", folder
            for part in row.path.split("/")[:-1]:
                at = f"{at}/{part}"
                if not os.path.isdir(at):
                    os.mkdir(at)
            with open(where, "x") as out:
                out.write(row.content or "")
        return _Attempt(folder)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        moves: dict[str, str] = {}
        try:
            for message in messages:
                for at, _, names in os.walk(message.folder) if message else ():
                    for name in names:
                        to = f"{self.root}/{os.path.relpath(f'{at}/{name}', message.folder)}"
                        if to in moves or os.path.lexists(to):
                            raise FileExistsError(f"the path is taken: {to}")
                        moves[to] = f"{at}/{name}"
            for to, staged in moves.items():
                os.makedirs(os.path.dirname(to), exist_ok=True)
                os.rename(staged, to)
        finally:
            self._clear()

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Remove what attempts have written; those still running fail at their next file."""
        for _ in range(100):
            shutil.rmtree(self.staging, ignore_errors=True)
            if not os.path.exists(self.staging):
                return
            time.sleep(0.1)


def write_files(rows: DataFrame, root: str) -> None:
    """Write (path, content) rows as files below ``root``."""
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(FilesSink)
    rows.select("path", "content").write.format("files").option("path", root).mode("append").save()
