"""Growing log files as a stream whose offsets are bytes.

A file is known by its device and inode, so it keeps its place when it is renamed.  An offset holds,
for each file, how many bytes of whole lines are read and checksums of its first bytes
(``MARKS``).  From two offsets alone, and so the same way after a restart, it follows what to read:

* the file was there and begins as before: the bytes in between (appended lines);
* it begins otherwise or is shorter: it was truncated or its inode taken over, so all of it;
* it is new and begins like a file that was truncated or went away: a rotated copy, so
  only what had not been read of that file;
* it is new: all of it.

A line counts once its line feed is written.  Ranges of ``split`` bytes are read by tasks of their own,
so the tasks must see the folder (a shared mount).  The driver looks at names and sizes, and at the
ends of files that grew.  Files whose names begin with ``.`` or ``_`` are left out.  Bytes that were planned
but are gone when a task wants them are an error, or left out where ``lost`` is ``skip``.
"""

from __future__ import annotations

import glob
import os
import stat
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

MARKS = (16, 64, 256, 1024)
BLOCK = 4 << 20
SPLIT = 64 << 20


class Lost(Exception):
    """Planned bytes that are no longer there."""


def identity(state: os.stat_result) -> str:
    return f"{state.st_dev}:{state.st_ino}"


def listing(pattern: str) -> Iterator[tuple[str, str, int]]:
    """(identity, path, size) of the files that match, and of those in folders that match."""
    seen = set()
    for match in sorted(glob.glob(pattern)):
        names = [os.path.join(folder, n) for folder, _, inside in os.walk(match) for n in sorted(inside)] \
            if os.path.isdir(match) else [match]
        for path in names:
            if os.path.basename(path)[0] in "._":
                continue
            try:
                state = os.stat(path)
            except FileNotFoundError:       # renamed since it was listed; the next offset has it
                continue
            if stat.S_ISREG(state.st_mode) and identity(state) not in seen:
                seen.add(identity(state))
                yield identity(state), path, state.st_size


def whole_lines(handle, size: int, known: int = 0) -> int:
    """Bytes up to the last line feed, looked for backwards down to ``known``."""
    end = size
    while end > known:
        start = max(known, end - (1 << 16))
        handle.seek(start)
        at = handle.read(end - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return known


def marks(handle, size: int) -> str:
    """Checksums of the first bytes, as far as whole lines go."""
    handle.seek(0)
    head = handle.read(min(size, MARKS[-1]))
    return " ".join(str(zlib.crc32(head[:n])) for n in MARKS if n <= size)


def begins_alike(old: dict, new: dict) -> bool:
    """Whether ``new`` may be ``old`` with more bytes behind it."""
    before, after = old["marks"].split(), new["marks"].split()
    return new["bytes"] >= old["bytes"] and after[:len(before)] == before


def ranges(start: dict, end: dict) -> list[tuple[str, str, int, int]]:
    """(identity, path, from, to) of what lies between two offsets."""
    out = []
    # files that lost their place: gone, or begun anew
    left = [e for name, e in start.items() if name not in end or not begins_alike(e, end[name])]
    for name, now in end.items():
        before = start.get(name)
        if before is not None:
            first = before["bytes"] if begins_alike(before, now) else 0
        else:
            copied = [e["bytes"] for e in left if e["marks"] and begins_alike(e, now)]
            first = max(copied, default=0)
        if first < now["bytes"]:
            out.append((name, now["path"], first, now["bytes"]))
    return out


class Range(InputPartition):
    def __init__(self, name: str, path: str, first: int, last: int, start: int, end: int):
        self.name, self.path, self.first, self.last, self.start, self.end = name, path, first, last, start, end


def after_line(handle, place: int, limit: int) -> int:
    """The first line start at or behind ``place``."""
    place -= 1
    while place < limit:
        handle.seek(place)
        block = handle.read(min(1 << 16, limit - place))
        if not block:
            raise Lost(f"the file ends at {place} instead of {limit}")
        at = block.find(b"\n")
        if at >= 0:
            return place + at + 1
        place += len(block)
    return limit


def texts(lines: list[bytes]) -> pa.Array:
    lines = [line[:-1] if line.endswith(b"\r") else line for line in lines]
    try:
        return pa.array(lines, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([line.decode("utf-8", "replace") for line in lines], pa.string())


def lines_of(handle, part: Range) -> Iterator[list[bytes]]:
    """Lines that start in the part, in blocks."""
    place = part.start if part.start == part.first else after_line(handle, part.start, part.last)
    end = part.end if part.end == part.last else after_line(handle, part.end, part.last)
    handle.seek(place)
    rest = b""
    while place < end:
        block = handle.read(min(BLOCK, end - place))
        if not block:
            raise Lost(f"the file ends at {place} instead of {end}")
        place += len(block)
        *lines, rest = (rest + block).split(b"\n")
        if lines:
            yield lines


class ByteTailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.pattern = options["path"].removeprefix("file://").removeprefix("file:")
        self.split, self.skips = int(options.get("split", SPLIT)), options.get("lost", "fail") == "skip"
        self.held: dict[str, dict] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for name, path, size in listing(self.pattern):
            held = self.held.get(name)
            try:
                with open(path, "rb") as handle:
                    if identity(os.fstat(handle.fileno())) != name:
                        continue
                    if held and held["size"] == size and held["marks"] == marks(handle, held["bytes"]):
                        done = held["bytes"]
                    else:
                        done = whole_lines(handle, size)
                    if done:
                        out[name] = {"path": path, "bytes": done, "marks": marks(handle, done), "size": size}
            except FileNotFoundError:
                continue
        self.held = out
        return {name: {k: v for k, v in e.items() if k != "size"} for name, e in out.items()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [Range(name, path, first, last, k, min(k + self.split, last))
                for name, path, first, last in ranges(start, end) for k in range(first, last, self.split)]

    def _open(self, part: Range):
        """The file by its path, or by its inode where it was renamed since."""
        for path in (part.path, None):
            found = path or next((p for name, p, _ in listing(self.pattern) if name == part.name), None)
            try:
                handle = open(found, "rb") if found else None
            except FileNotFoundError:
                continue
            if handle and identity(os.fstat(handle.fileno())) == part.name:
                return handle
            if handle:
                handle.close()
        raise Lost(f"{part.path} is gone")

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        try:
            with self._open(part) as handle:
                for lines in lines_of(handle, part):
                    yield pa.RecordBatch.from_arrays(
                        [texts(lines), pa.array([part.path] * len(lines), pa.string())], names=["value", "file"])
        except Lost:
            if not self.skips:
                raise

    def commit(self, end: dict) -> None:
        pass


class ByteTail(DataSource):
    """``spark.readStream.format("byte_tail")``; options path, split, lost."""

    @classmethod
    def name(cls) -> str:
        return "byte_tail"

    def schema(self) -> str:
        return "value string, file string"

    def streamReader(self, schema) -> ByteTailReader:
        return ByteTailReader(self.options)
