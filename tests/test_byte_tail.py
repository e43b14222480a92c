"""A tail that gives every line once through appends, rotation, truncation and restarts."""

import os
from collections import Counter

import pytest

from edgetide.streaming import byte_tail, tail


class Log:
    """A log on disk and the stream that follows it; every ``drain`` is a restart from the checkpoint."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options, self.n = spark, folder, options, 0
        self.path, self.written = str(folder / "logs" / "access.log"), []
        os.makedirs(folder / "logs")

    def write(self, lines, end="\n", mode="a", path=None):
        lines = [f"{self.n + k:05d} line {'x' * (k % 50)}" for k in range(lines)] if isinstance(lines, int) else lines
        self.n += len(lines)
        with open(path or self.path, mode) as out:
            out.write("".join(line + end for line in lines))
        self.written += lines

    def drain(self):
        query = (tail.tail_lines(self.spark, f"{self.folder}/logs/access.log*", **self.options).writeStream.format("parquet")
                 .option("path", str(self.folder / "out")).option("checkpointLocation", str(self.folder / "checkpoint"))
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        if query.exception():
            raise query.exception()

    def lines(self):
        return Counter(r.value for r in self.spark.read.parquet(str(self.folder / "out")).collect())

    def check(self):
        self.drain()
        assert self.lines() == Counter(self.written)


@pytest.fixture
def log(spark, tmp_path):
    return Log(spark, tmp_path)


def test_appended_lines_arrive(log):
    log.write(5)
    log.check()
    log.write(3)
    log.check()
    log.check()                 # nothing new
    with open(log.path, "a") as out:
        out.write("half a li")
    log.check()
    with open(log.path, "a") as out:
        out.write("ne\n")
    log.written.append("half a line")
    log.check()


def test_rotation_is_followed(log):
    log.write(100)
    log.check()
    log.write(20)               # unread when the file is renamed
    os.rename(log.path, log.path + ".1")
    log.write(7)
    log.check()
    for turn in range(3):
        log.write(11)
        os.rename(log.path + ".1", log.path + ".2")
        os.rename(log.path, log.path + ".1")
        log.write(turn + 1)
        log.check()


def test_truncation_starts_anew(log):
    log.write(100)
    log.check()
    log.write(30, mode="w")
    log.check()
    log.write(200)
    log.check()


def test_truncated_copy_is_not_read_twice(log):
    log.write(100)
    log.check()
    log.write(20)
    with open(log.path) as old, open(log.path + ".1", "w") as copy:
        copy.write(old.read())
    log.write(5, mode="w")
    log.check()


def test_taken_over_inode(log):
    log.write(100)
    log.check()
    os.remove(log.path)
    log.write(300)              # the file system may give the same inode again
    log.check()


def test_ranges_split_at_lines(spark, tmp_path):
    log = Log(spark, tmp_path, split=97)
    log.write(60)
    log.write(["", "", "y" * 1000, "é" * 70, "end\r"])
    log.written[-1] = "end"
    log.check()
    log.write(40)
    log.check()


def test_bytes_that_are_no_text(spark, log):
    with open(log.path, "wb") as out:
        out.write(b"good\nb\xffd\n")
    log.written += ["good", "b�d"]
    log.check()


def test_lost_bytes_are_an_error_or_left_out(spark, tmp_path):
    path = tmp_path / "access.log"
    path.write_text("one line of some length\n" * 10)
    for lost in ("fail", "skip"):
        reader = byte_tail.ByteTailReader({"path": str(path), "lost": lost})
        planned = reader.partitions({}, reader.latestOffset())
        os.truncate(path, 30)
        if lost == "fail":
            with pytest.raises(byte_tail.Lost):
                list(reader.read(planned[0]))
            path.write_text("one line of some length\n" * 10)
        else:
            assert [b.num_rows for b in reader.read(planned[0])] == [1]      # what is still there
            os.remove(path)
            assert list(reader.read(planned[0])) == []


def test_equal_offsets_and_no_files(tmp_path):
    reader = byte_tail.ByteTailReader({"path": str(tmp_path / "none*")})
    assert reader.latestOffset() == {} and reader.partitions({}, {}) == []
