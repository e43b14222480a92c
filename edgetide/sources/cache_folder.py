"""Inventory of a cache folder, listed by the tasks.

An edge spreads its cache over folders named after the ends of the keys' hashes.  The driver
reads the names of the first ``LEVELS`` of them and nothing below; every such folder is a partition, whose
task walks it and takes each file's size and times.  A cache changes while it is listed: a file
or folder that vanishes meanwhile is a row with an ``error`` instead of an end of the job.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LEVELS = 1
ROWS = 8192
SCHEMA = "path string, size long, changed_at timestamp, accessed_at timestamp, error string"
_ARROW = pa.schema([("path", pa.string()), ("size", pa.int64()), ("changed_at", pa.timestamp("us", "UTC")),
                    ("accessed_at", pa.timestamp("us", "UTC")), ("error", pa.string())])


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


def _state(path: str) -> tuple:
    try:
        state = os.stat(path, follow_symlinks=False)
    except OSError as error:
        return path, None, None, None, error.strerror
    return path, state.st_size, state.st_mtime_ns // 1000, state.st_atime_ns // 1000, None


def walk(top: str, deep: bool) -> Iterator[tuple]:
    """A row for each file below ``top``, or of ``top`` alone; folders are held as open listings only."""
    folders = [top]
    while folders:
        folder = folders.pop()
        try:
            with os.scandir(folder) as entries:
                for entry in entries:
                    if not entry.is_dir(follow_symlinks=False):
                        yield _state(entry.path)
                    elif deep:
                        folders.append(entry.path)
        except OSError as error:
            yield folder, None, None, None, error.strerror


class FolderReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        self.levels = int(options.get("levels", LEVELS))

    def partitions(self) -> list[Folder]:
        """The folders ``levels`` down; those above hold only what lies in them directly."""
        out, level = [], [self.path]
        for _ in range(self.levels):
            out += [Folder(path, False) for path in level]
            level = [e.path for path in level for e in os.scandir(path) if e.is_dir(follow_symlinks=False)]
        return out + [Folder(path, True) for path in level]

    def read(self, part: Folder) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in walk(part.path, part.deep):
            rows.append(row)
            if len(rows) == ROWS:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class CacheFolder(DataSource):
    """``spark.read.format("cache_folder")``; options path, levels."""

    @classmethod
    def name(cls) -> str:
        return "cache_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)
