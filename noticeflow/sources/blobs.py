"""A content-addressed store and a receipt sink (S8, S17) as Spark data sources that tasks may run again.

What a row leaves is one file whose name follows from the row alone, written aside and then moved: a task that fails, is repeated or runs twice
at once leaves each file once and whole. The path is of any file system that pyarrow reaches from all executors; rows never pass the driver.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

#: Fixed value: a store's file names.
KEY_PATTERN = r"^[0-9a-f]{64}$"


@dataclass
class Written(WriterCommitMessage):
    new: int
    known: int


def blob(row) -> tuple[str, bytes]:
    """A row's `content` under its SHA-256."""
    content = bytes(row["content"]) if not isinstance(row["content"], str) else row["content"].encode()
    return hashlib.sha256(content).hexdigest(), content


def receipt(row) -> tuple[str, bytes]:
    """What stands of a delivery under its `dedupe_key`: the row as JSON."""
    said = {k: v for k, v in row.asDict().items() if v is not None}
    return hashlib.sha256(row["dedupe_key"].encode()).hexdigest(), json.dumps(said, sort_keys=True, ensure_ascii=False, default=str).encode()


class _Files:
    """The writers of both: `make` gives each row's name and bytes. Rows without what names them (null) leave nothing."""

    def __init__(self, path: str, needed: str, make):
        self.path, self.needed, self.make = path, needed, make

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def _put(self, files, name: str, content: bytes) -> None:
        folder = name.rpartition("/")[0]
        files.create_dir(folder, recursive=True)
        aside = f"{folder}/.incoming-{uuid.uuid4().hex}"
        with files.open_output_stream(aside) as out:
            out.write(content)
        files.move(aside, name)  # the same bytes, if another task was first

    def write(self, iterator: Iterator) -> Written:
        from pyarrow import fs

        files, top = self._open()
        new = known = 0
        for row in iterator:
            if row[self.needed] is None:
                continue
            key, content = self.make(row)
            name = f"{top}/{key[:2]}/{key}"
            if files.get_file_info(name).type != fs.FileType.NotFound:
                known += 1
            else:
                self._put(files, name, content)
                new += 1
        return Written(new, known)

    def _note(self, name: str, messages: list) -> None:
        """A run's counts; nothing else depends on it."""
        files, top = self._open()
        done = [m for m in messages if m is not None]
        self._put(files, f"{top}/_runs/{name}", json.dumps({"new": sum(m.new for m in done), "known": sum(m.known for m in done)}).encode())


class BatchFiles(_Files, DataSourceWriter):
    def commit(self, messages) -> None:
        self._note(uuid.uuid4().hex, messages)

    def abort(self, messages) -> None:
        """What tasks have left is whole and has its right name: the next run finds it."""


class StreamFiles(_Files, DataSourceStreamWriter):
    def commit(self, messages, batchId: int) -> None:
        self._note(f"batch-{batchId}", messages)

    def abort(self, messages, batchId: int) -> None:
        """As for a batch."""


class _Sink(DataSource):
    needed, make = "content", staticmethod(blob)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("what is stored stays: append to it")
        return BatchFiles(self.options["path"], self.needed, type(self).make)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return StreamFiles(self.options["path"], self.needed, type(self).make)


class BlobSink(_Sink):
    """format("noticeblobs"), option path: rows with `content` (binary or text)."""

    @classmethod
    def name(cls) -> str:
        return "noticeblobs"


class ReceiptSink(_Sink):
    """format("noticereceipts"), option path: rows with `dedupe_key`."""

    needed, make = "dedupe_key", staticmethod(receipt)

    @classmethod
    def name(cls) -> str:
        return "noticereceipts"


def register(spark) -> None:
    """All sources and sinks of the package that are Python data sources."""
    from noticeflow.sources import feed, windows

    feed.register(spark)
    for source in (windows.WindowSource, BlobSink, ReceiptSink):
        spark.dataSource.register(source)
