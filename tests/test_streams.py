"""Change logs, versions and keyed state over many batches, with crashes, replays and late rows."""

import datetime as dt
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from edgetide.operators import trace
from edgetide.sources.versions import Taken, Versions
from edgetide.streaming import change_log, running, state
from edgetide.streaming.change_log import ChangeLog

DAY = dt.datetime(2024, 1, 1)


def files_below(path):
    return [f for folder, _, names in os.walk(path) for f in names if f.endswith((".parquet", ".json"))]


def changes(spark, rows):
    return spark.createDataFrame(rows, "region string, file_id string, n long, word string")


def held(log):
    return {(r.region, r.file_id): (r.n, r.word) for r in log.current().collect()}


def test_log_of_many_batches(spark, tmp_path, monkeypatch):
    rng, path, expected = random.Random(1), str(tmp_path / "log"), {}
    keys = [(r, f) for r in ("eu", None) for f in ("a", "b", "c", None, "d")]
    publish, most = Versions.publish, 0
    for batch in range(40):
        rows = [(*k, batch, None if rng.random() < .2 else f"w{batch}") for k in rng.sample(keys, rng.randrange(0, 6))]
        if batch % 7 == 3:      # the writer dies between its merges and the manifest
            with monkeypatch.context() as patch:
                patch.setattr(Versions, "publish", lambda *a: (_ for _ in ()).throw(OSError("killed")))
                with pytest.raises(OSError):
                    ChangeLog(spark, path, ["region", "file_id"], "s").append(batch, changes(spark, rows))
            if batch > 3:
                assert held(ChangeLog(spark, path, ["region", "file_id"])) == expected
        ChangeLog(spark, path, ["region", "file_id"], "s").append(batch, changes(spark, rows))
        expected |= {r[:2]: r[2:] for r in rows}
        log = ChangeLog(spark, path, ["region", "file_id"], "s")
        log.append(batch, changes(spark, [("eu", "a", -1, "again")]))       # run again: written already
        most = max(most, len(log.manifest["runs"]))
    assert held(log) == expected and Versions.publish is publish
    assert most <= (change_log.FAN - 1) * 3
    assert len(files_below(path)) < 80
    with pytest.raises(change_log.OtherStream):
        ChangeLog(spark, path, ["region", "file_id"], "another")


def test_log_forgets(spark, tmp_path):
    path = str(tmp_path / "log")
    for batch in range(9):
        log = ChangeLog(spark, path, ["region", "file_id"], "s", keep=F.col("n") >= 4)
        log.append(batch, changes(spark, [("eu", f"f{batch}", batch, "w")]))
    log = ChangeLog(spark, path, ["region", "file_id"], "s", keep=F.col("n") >= 4)
    assert sorted(n for n, _ in held(log).values()) == [4, 5, 6, 7, 8]
    assert sum(spark.read.parquet(f"{path}/{r['folder']}").count() for r in log.manifest["runs"]) < 9


def test_second_writer_is_refused(spark, tmp_path):
    path = str(tmp_path / "log")
    ChangeLog(spark, path, ["region", "file_id"], "s").append(0, changes(spark, [("eu", "a", 1, "w")]))
    one, two = (ChangeLog(spark, path, ["region", "file_id"], "s") for _ in range(2))
    one.append(1, changes(spark, [("eu", "a", 2, "w")]))
    with pytest.raises(Taken):
        two.append(1, changes(spark, [("eu", "a", 3, "w")]))
    assert held(ChangeLog(spark, path, ["region", "file_id"])) == {("eu", "a"): (2, "w")}


def batches_of_accesses(n=22, seed=2):
    """Batches of (region, file, ts, key); every fifth is late, one is empty, keys may be null."""
    rng, out, key = random.Random(seed), [], 0
    for b in range(n):
        base = DAY + dt.timedelta(hours=3 * b - (10 if b % 5 == 4 else 0))
        rows = []
        for _ in range(0 if b == 7 else rng.randrange(5, 30)):
            key += 1
            rows.append((rng.choice(["eu", "us", None]), rng.choice(["hot", "hot", "a", "b", None]),
                         base + dt.timedelta(seconds=rng.randrange(9000)), key))
        out.append(rows)
    return out


SCHEMA = "cdn_region string, file_id string, ts timestamp, key long"


def stream_of(spark, folder, batches):
    """A file per batch, read one at a time."""
    for b, rows in enumerate(batches):
        path = f"{folder}/in/{b:03d}.json"
        if not os.path.exists(path):
            os.makedirs(f"{folder}/in", exist_ok=True)
            with open(path, "w") as out:
                for region, name, ts, key in rows:
                    quoted = [("null" if v is None else f'"{v}"') for v in (region, name)]
                    out.write(f'{{"cdn_region":{quoted[0]},"file_id":{quoted[1]},"ts":"{ts:%Y-%m-%d %H:%M:%S}","key":{key}}}\n')
            os.utime(path, (1_700_000_000 + b, 1_700_000_000 + b))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{folder}/in")


def run(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def test_features_over_batches(spark, tmp_path, monkeypatch):
    batches, where = batches_of_accesses(), [str(tmp_path / n) for n in ("out", "state", "checkpoint")]
    real, calls = trace.object_state, []

    def dies_once(*args, **more):
        calls.append(1)
        if len(calls) == 9:
            raise OSError("killed")
        return real(*args, **more)

    monkeypatch.setattr(trace, "object_state", dies_once)
    for attempt in range(2):
        try:
            run(state.stream_features(stream_of(spark, tmp_path, batches), "key", *where))
        except Exception:
            assert attempt == 0
    expected, seen, last = {}, defaultdict(int), {}
    for rows in batches:
        latest = dict(last)
        for region, name, ts, key in sorted(rows, key=lambda r: (r[2], r[3])):
            seen[region, name] += 1
            before = latest.get((region, name))
            expected[key] = (seen[region, name], (ts - before).total_seconds() if before else 0.0)
            latest[region, name] = ts
        for k, ts in latest.items():
            last[k] = max(ts, last.get(k, ts))
    got = {r.key: (r.access_count, r.age_since_last_access) for r in spark.read.parquet(where[0]).collect()}
    assert got == expected
    log = ChangeLog(spark, where[1], ["cdn_region", "file_id"])
    assert log.current().count() == len(seen) and len(log.manifest["runs"]) <= (change_log.FAN - 1) * 3


def test_frequencies_over_batches(spark, tmp_path):
    batches, where = batches_of_accesses(seed=6), [str(tmp_path / n) for n in ("state", "checkpoint")]
    for part in (9, len(batches)):      # a restart in between
        run(state.stream_frequencies(stream_of(spark, tmp_path, batches[:part]), *where))
    table, clock = {}, None
    for rows in batches:
        if not rows:
            continue
        as_of, counts, newest = max(r[2] for r in rows), defaultdict(int), {}
        for region, name, ts, _ in rows:
            counts[region, name] += 1
            newest[region, name] = max(ts, newest.get((region, name), ts))
        hours = (as_of - clock).total_seconds() / 3600 if clock else 0.0
        if clock is None or hours >= 1:
            table = {k: f * .99 ** hours for k, f in table.items() if f * .99 ** hours >= .1}
            clock = as_of
        for k, n in counts.items():
            fresh = n * max(.1, 1 - (as_of - newest[k]).total_seconds() / 86400)
            table[k] = max(table.get(k, 0.0), fresh)
    got = {(r.cdn_region, r.file_id): r.frequency for r in state.current_frequencies(spark, where[0]).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in table.items()}


def test_objects_are_forgotten(spark, tmp_path):
    rows = [[("eu", "a", DAY, 1)], [("eu", "b", DAY + dt.timedelta(days=9), 2)], [("eu", "a", DAY + dt.timedelta(days=9), 3)]]
    where = [str(tmp_path / n) for n in ("out", "state", "checkpoint")]
    run(state.stream_features(stream_of(spark, tmp_path, rows), "key", *where, forget="5 days"))
    assert {r.key: r.access_count for r in spark.read.parquet(where[0]).collect()} == {1: 1, 2: 1, 3: 1}


def test_late_rows_are_kept_and_counted(spark, tmp_path, monkeypatch):
    batches, where = batches_of_accesses(24, seed=9), [str(tmp_path / n) for n in ("counts", "late", "checkpoint")]
    real, calls = ChangeLog.append, []

    def dies_once(log, *args):
        calls.append(1)
        if len(calls) == 10:        # after the late rows of that batch are written
            raise OSError("killed")
        real(log, *args)

    monkeypatch.setattr(ChangeLog, "append", dies_once)
    for attempt in range(2):
        try:
            run(running.count_intervals(stream_of(spark, tmp_path, batches), ["cdn_region"], *where, every="10 minutes"))
        except Exception:
            assert attempt == 0
    counts, late, mark = defaultdict(int), set(), None
    for rows in batches:
        for region, _, ts, key in rows:
            start = ts.replace(minute=ts.minute // 10 * 10, second=0)
            if mark and start + dt.timedelta(minutes=10) <= mark:
                late.add(key)
            else:
                counts[start, region] += 1
        if rows:
            mark = max(filter(None, (mark, max(r[2] for r in rows) - dt.timedelta(minutes=1))))
    assert late and sorted(r.key for r in running.late_rows(spark, where[1]).collect()) == sorted(late)
    got = {(r.window_start, r.cdn_region): r.requests for r in running.interval_values(
        spark, where[0], ["cdn_region"], "10 minutes", closed=False).collect()}
    assert got == counts
    closed = running.interval_values(spark, where[0], ["cdn_region"], "10 minutes").collect()
    assert {r.window_start for r in closed} == {w for w, _ in counts if w + dt.timedelta(minutes=10) <= mark}
