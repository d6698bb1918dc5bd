"""A data source that writes one named file a row, some folders in all."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Staged(WriterCommitMessage):
    """Folder of one task's attempt, and how many files it holds."""

    folder: str
    files: int


class _Writer(DataSourceWriter):
    """Each attempt of a task writes into a folder of its own below ``_staged``. A commit moves the folders of
    the attempts that count beside it, a rename a task, and drops the rest, so a repeated task leaves no file twice; an abort
    drops all. Names repeat only across tasks, where their folders differ."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Staged:
        return self._put((row["name"], (row["content"] or "").encode()) for row in rows)

    def _put(self, files: Iterator[tuple[str | None, bytes | pa.Buffer]]) -> Staged:
        system, base = opened(self.path)
        folder, n = f"{base}/_staged-{self.run}/part-{uuid.uuid4().hex}", 0
        for name, content in files:
            if name is None:
                raise ValueError("a file without a name")
            if not n:
                system.create_dir(folder)
            with system.open_output_stream(f"{folder}/{name}") as out:
                out.write(content)
            n += 1
        return Staged(posixpath.basename(folder), n)

    def commit(self, messages: list[Staged | None]) -> None:
        system, base = opened(self.path)
        if self.overwrite:
            for found in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if found.base_name.startswith("part-"):
                    system.delete_dir(found.path)
        system.create_dir(base)
        for m in messages:
            if m and m.files:
                system.move(f"{base}/_staged-{self.run}/{m.folder}", f"{base}/{m.folder}")
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, base = opened(self.path)
        staged = f"{base}/_staged-{self.run}"
        if system.get_file_info(staged).type == fs.FileType.Directory:
            system.delete_dir(staged)


class _BatchWriter(_Writer, DataSourceArrowWriter):
    """Contents go from Arrow's buffers to the files, one at a time: a batch of rows is never text in Python."""

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        pairs = (pair for b in batches for pair in zip(b.column("name"), b.column("content")))
        return self._put((name.as_py(), content.as_buffer() if content.is_valid else b"") for name, content in pairs)


class NamedFiles(DataSource):
    """``df.write.format("named_files")`` for rows of (name, content): a file a row, a folder a task."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _BatchWriter(self.options["path"], overwrite)


def write_files(rows: DataFrame, path: str) -> None:
    """``rows`` (name, content) as files below ``path``, in place of what it wrote there before. A path is one that the
    Python workers reach: a shared folder, or a URI that Arrow knows. Null contents are empty files; null names are an error."""
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("name", "content").write.format("named_files").mode("overwrite").save(path)
