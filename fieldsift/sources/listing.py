"""The files of a folder as a table, one row per listed name whatever it holds.

A Python data source.  The driver names folders only; each task lists its slice of a folder
and reads the files in it, so neither names nor texts pass through the driver.  Unlike
Spark's file readers it does not skip names that begin with ``_`` or ``.``, and a file that
cannot be read, or is no text, becomes a row with a status instead of failing the job.

Statuses: ``ok``; ``not_utf8`` (the bytes are no UTF-8; no text); ``unreadable`` (the store
refused it, or it went meanwhile); ``not_a_file`` (a folder with a matching name);
``too_large`` (more bytes than a string value can hold).

Paths are those ``pyarrow.fs`` opens: plain and ``file:`` paths that all executors share,
``hdfs:``, ``s3:``, ``gs:`` and ``abfs:``.
"""

from __future__ import annotations

import fnmatch
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SOURCE = "document_folder"
SCHEMA = "source_path string, size long, modified timestamp, status string, error string, text string"
MOST_BYTES = (1 << 31) - (1 << 20)
BATCH_BYTES = 16 << 20

OK, NOT_UTF8, UNREADABLE, NOT_A_FILE, TOO_LARGE = (
    "ok", "not_utf8", "unreadable", "not_a_file", "too_large",
)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path within it."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path.removeprefix("file:")
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class Slice(InputPartition):
    """Names of one folder whose checksum falls into one of ``slices`` classes."""

    folder: str
    number: int
    slices: int

    def holds(self, name: str) -> bool:
        return zlib.crc32(name.encode("utf-8", "surrogateescape")) % self.slices == self.number


class FolderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/") or "/"
        self.pattern = options.get("pattern", "*.pdf")
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.slices = int(options.get("slices", "8"))
        self.content = options.get("content", "true").lower() == "true"

    def partitions(self) -> list[Slice]:
        store, root = opened(self.path)
        if store.get_file_info(root).type != fs.FileType.Directory:
            raise FileNotFoundError(self.path)
        folders = [root]
        if self.recursive:
            within = fs.FileSelector(root, recursive=True)
            folders += [x.path for x in store.get_file_info(within) if x.type == fs.FileType.Directory]
        return [Slice(f, k, self.slices) for f in sorted(folders) for k in range(self.slices)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        schema = pa.schema(
            [
                ("source_path", pa.string()), ("size", pa.int64()),
                ("modified", pa.timestamp("us", tz="UTC")), ("status", pa.string()),
                ("error", pa.string()), ("text", pa.string()),
            ]
        )
        rows, held = [], 0
        for info in self._listed(store, partition):
            rows.append(self._row(store, info))
            held += len(rows[-1]["text"] or "")
            if held >= BATCH_BYTES or len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _listed(self, store: fs.FileSystem, partition: Slice) -> Iterator[fs.FileInfo]:
        if isinstance(store, fs.LocalFileSystem):
            # A link to nothing is a listed name too; the selector would leave it out.
            names = sorted(os.listdir(partition.folder))
        else:
            names = [x.base_name for x in store.get_file_info(fs.FileSelector(partition.folder))]
        for name in names:
            if partition.holds(name) and fnmatch.fnmatchcase(name, self.pattern):
                path = f"{partition.folder.rstrip('/')}/{name}"
                try:
                    yield store.get_file_info(path)
                except (OSError, UnicodeError):
                    shown = path.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
                    yield fs.FileInfo(shown, fs.FileType.NotFound)

    def _row(self, store: fs.FileSystem, info: fs.FileInfo) -> dict:
        row = {
            "source_path": info.path, "size": info.size, "modified": info.mtime,
            "status": OK, "error": None, "text": None,
        }
        if info.type == fs.FileType.Directory:
            return row | {"status": NOT_A_FILE, "error": f"Not a file: {info.path}"}
        if info.type == fs.FileType.NotFound:
            return row | {"status": UNREADABLE, "error": f"File cannot be read: {info.path}"}
        if info.size is not None and info.size > MOST_BYTES:
            return row | {"status": TOO_LARGE, "error": f"File of {info.size} bytes: {info.path}"}
        if not self.content:
            return row
        try:
            with store.open_input_stream(info.path) as stream:
                data = stream.read()
            return row | {"text": data.decode("utf-8")}
        except UnicodeDecodeError as e:
            return row | {"status": NOT_UTF8, "error": f"Not UTF-8 at byte {e.start}: {info.path}"}
        except OSError:
            return row | {"status": UNREADABLE, "error": f"File cannot be read: {info.path}"}


class DocumentFolder(DataSource):
    """``spark.read.format("document_folder").option("pattern", "*.pdf").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def list_documents(
    spark: SparkSession,
    folder: str,
    *,
    pattern: str = "*.pdf",
    recursive: bool = False,
    slices: int = 8,
    content: bool = True,
) -> DataFrame:
    """A row for every name in the folder that matches, case-sensitively.

    ``slices`` tasks share a folder; each lists all its names, and reads its own.  Without
    ``content`` no file is opened and ``text`` is null.
    """
    spark.dataSource.register(DocumentFolder)
    return (
        spark.read.format(SOURCE)
        .option("pattern", pattern)
        .option("recursive", str(recursive).lower())
        .option("slices", slices)
        .option("content", str(content).lower())
        .load(folder)
    )


def usable(listed: DataFrame) -> DataFrame:
    """``source_path, text`` of the files that hold text."""
    return listed.where(F.col("status") == OK).select("source_path", "text")


def failed_items(listed: DataFrame) -> DataFrame:
    """The others as items of a batch: each with its error."""
    nothing = F.lit(None).cast("string")
    return listed.where(F.col("status") != OK).select(
        F.col("source_path").alias("pdf"),
        F.lit("error").alias("status"),
        nothing.alias("output"),
        F.col("error"),
        nothing.alias("reason"),
    )
