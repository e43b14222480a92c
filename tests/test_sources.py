"""Edge rows of the scans."""

import json
import os

import pytest

from pyspark.sql import functions as F

from edgetide.plans import evict
from edgetide.sources import access_logs, cache_folder, cache_indexes, catalogue, probes

GOOD = ('192.0.2.7 - - [05/Jun/2025:10:11:12 +0000] "GET /static/images/image_4.jpg HTTP/1.1" '
        '200 12345 "https://site.example/images/trending" "Mozilla/5.0 Chrome/136"')


def lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_plain_lines(spark):
    rows = [
        GOOD, "noise", GOOD.replace("05/Jun", "99/Foo"), GOOD.replace(".jpg", ".css"),
        GOOD.replace("image_4.jpg", "UP.JPG"), GOOD.replace(".jpg", ".jpg?v=1"),
        GOOD.replace("image_4.jpg", "a.b.jpg"), GOOD.replace("192.0.2.7", "::1"),
        GOOD.replace(" - - ", " - bob "), GOOD.replace(" 12345 ", " - "),
        GOOD + ' "-" cache_status=HIT cdn_region=sea lat=- rt=0.004',
        GOOD.replace("+0000", "+0700"),
    ]
    got = access_logs.parse_plain(lines(spark, rows)).collect()
    assert sorted((r.file_id, str(r.ts)) for r in got) == [
        ("UP", "2025-06-05 10:11:12"), ("a", "2025-06-05 10:11:12"),
        ("image_4", "2025-06-05 03:11:12"), ("image_4", "2025-06-05 10:11:12"),
        ("image_4", "2025-06-05 10:11:12")]
    with_query = access_logs.parse_plain(lines(spark, [rows[5]]), strip_query=True).collect()
    assert with_query[0].file_type == "image"


def test_time_does_not_follow_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = access_logs.parse_plain(lines(spark, [GOOD])).select(
            F.col("ts").cast("string")).first()[0]
        assert got == "2025-06-05 10:11:12"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_extended_lines(spark):
    tail = ' "-" cache_status=HIT cdn_region=- lat=- rt=0.004'
    no_version = GOOD.replace(" HTTP/1.1", "") + tail
    rows = [GOOD + tail, GOOD, GOOD.replace('"https://site.example/images/trending"', '""') + tail,
            no_version, GOOD + tail.replace("rt=0.004", "rt=-")]
    got = access_logs.split_request(access_logs.parse_extended(
        lines(spark, rows), region_from=F.lit("sea"))).collect()
    assert len(got) == 3
    assert [r.lat for r in got] == [None] * 3 and {r.cdn_region for r in got} == {"sea"}
    assert sorted(str(r.http_version) for r in got) == ["HTTP/1.1", "HTTP/1.1", "None"]
    assert sorted(str(r.request_time) for r in got) == ["0.004", "0.004", "None"]


def test_csv_round_trip_and_bad_values(spark, tmp_path):
    text = ("ip,timestamp,url,file_id,file_type,status,size,referrer,user_agent\n"
            '1.1.1.1,2025-06-05T10:11:12+00:00,/a.jpg,a,image,200,abc,"r, ""q""",ua\n'
            "1.1.1.1,never,/a.jpg,,image,x,5,r,ua\n")
    (tmp_path / "a.csv").write_text(text)
    got = access_logs.read_accesses_csv(spark, str(tmp_path / "a.csv")).collect()
    assert got[0].size is None and got[0].referrer == 'r, "q"' and got[0].status == 200
    assert str(got[0].ts) == "2025-06-05 10:11:12"
    assert got[1].ts is None and got[1].status is None and got[1].size == 5


def test_index_json(spark, tmp_path):
    index = {"fc/90/x": {"last_access": "2025-06-05T10:11:12", "size": 5, "type": "image"},
             "aa/bb/y": {"size": 0, "access_count": 3}}
    for region in ("sea", "eu-west"):
        (tmp_path / f"cache_index_{region}.json").write_text(json.dumps(index, indent=2))
    one = cache_indexes.read_index(spark, str(tmp_path / "cache_index_sea.json")).collect()
    assert {r.file_id: (r.size, r.access_count, r.last_access) for r in one} == {
        "fc/90/x": (5, None, "2025-06-05T10:11:12"), "aa/bb/y": (0, 3, None)}
    both = cache_indexes.read_regional_indexes(spark, str(tmp_path / "cache_index_*.json"))
    assert sorted(r.region for r in both.collect()) == ["eu-west", "eu-west", "sea", "sea"]
    (tmp_path / "empty.json").write_text("{}")
    assert cache_indexes.read_index(spark, str(tmp_path / "empty.json")).count() == 0


ODD_KEYS = ["a", 'q"uote', "brace}", "line\n  },\n  {", "  },", "\u00e9 \U0001f600", "}}", ""]


@pytest.mark.parametrize("n", [1, 2, 3000])
def test_large_index_is_split(spark, tmp_path, n):
    index = {f"{ODD_KEYS[k % len(ODD_KEYS)]}{k}": {"last_access": "2025-06-05T10:11:12", "size": k, "type": "im}\n  },\n",
                                                "access_count": k % 7} for k in range(n)}
    (tmp_path / "cache_index_sea.json").write_text(json.dumps(index, indent=2))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        read = cache_indexes.read_regional_indexes(spark, str(tmp_path / "cache_index_*.json"))
        assert n < 3000 or read.rdd.getNumPartitions() > 10
        assert {r.file_id: (r.size, r.access_count, r.type, r.region) for r in read.collect()} == {
            k: (v["size"], v["access_count"], v["type"], "sea") for k, v in index.items()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("text", ["{}", "{\n}", " {} \n", "", '{"a": {"size": 1}}', '{"a": {"size": 1}, "b": {}}\n',
                                  '{\n  "a": {}\n}', '{\n  "a": {},\n  "b": {\n    "size": 2\n  }\n}\n'])
def test_index_layouts(spark, tmp_path, text):
    (tmp_path / "index.json").write_text(text)
    got = {r.file_id: r.size for r in cache_indexes.read_index(spark, str(tmp_path / "index.json")).collect()}
    assert got == {k: v.get("size") for k, v in json.loads(text or "{}").items()}


def index_rows(spark, n, tag):
    return spark.range(n).selectExpr("concat('r', id % 2) region", "concat('f', id) file_id", "'t' last_access", "id size",
                                     f"'{tag}' type", "id access_count")


def test_index_is_published_whole_or_not(spark, tmp_path):
    path = str(tmp_path / "index")
    cache_indexes.write_index_lines(index_rows(spark, 50, "old"), path)
    before = sorted(map(tuple, cache_indexes.read_index_lines(spark, path).collect()))
    dies = index_rows(spark, 5000, "new").withColumn("type", F.expr("if(size = 4321, raise_error('killed'), type)"))
    with pytest.raises(Exception, match="killed"):
        cache_indexes.write_index_lines(dies, path)
    assert sorted(map(tuple, cache_indexes.read_index_lines(spark, path).collect())) == before
    reader = cache_indexes.read_index_lines(spark, path)
    cache_indexes.write_index_lines(index_rows(spark, 20, "new"), path)
    assert reader.count() == 50         # a reader of the old version is not disturbed
    assert {r.type for r in cache_indexes.read_index_lines(spark, path).collect()} == {"new"}
    for _ in range(3):
        cache_indexes.write_index_lines(index_rows(spark, 5, "newer"), path)
    assert len(list((tmp_path / "index" / "data").iterdir())) == 2


def test_plan_from_index_files(spark, tmp_path):
    entries = {f"f{k}": {"last_access": f"2025-06-0{k % 9 + 1}T00:00:00", "size": 400_000, "type": "image"} for k in range(8)}
    entries |= {"bad": {"last_access": "never", "size": 9}, "none": {"size": 5}, "empty": {"last_access": "2025-06-01", "size": 0}}
    (tmp_path / "cache_index_sea.json").write_text(json.dumps(entries, indent=2))
    plan = evict.from_index(spark, str(tmp_path / "cache_index_*.json"), "LRU", "2025-07-01 00:00:00", 1,
                            publish_to=str(tmp_path / "next"))
    gone = {r.file_id for r in plan.evicted.collect()}
    assert len(gone) == 6 and "f0" in gone and not gone & {"bad", "none", "empty"}
    left = {r.file_id: r for r in cache_indexes.read_index_lines(spark, str(tmp_path / "next")).collect()}
    assert set(left) == set(entries) - gone and left["bad"].last_access == "never" and left["none"].last_access is None
    again = evict.from_index(spark, str(tmp_path / "next"), "LRU", "2025-07-01 00:00:00", 1)
    assert again.evicted.count() == 0
    with pytest.raises(ValueError):
        evict.from_index(spark, str(tmp_path / "next"), "LRB", "2025-07-01 00:00:00", 1)


def test_cache_folder_reads_no_content(spark, tmp_path):
    (tmp_path / "fc" / "90").mkdir(parents=True)
    (tmp_path / "fc" / "90" / ("0" * 30 + "fc")).write_bytes(b"12345")
    got = cache_indexes.read_cache_folder(spark, str(tmp_path))
    row = got.first()
    assert row.size == 5 and row.hash == "0" * 30 + "fc"
    assert "content" not in got.columns and row.error is None and row.accessed_at is not None


def test_cache_folder_is_listed_by_tasks(spark, tmp_path):
    for k in range(30):
        folder = tmp_path / f"{k % 5:02x}" / f"{k % 3:02x}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"file{k}").write_bytes(b"x" * k)
    (tmp_path / "top").write_text("top")
    (tmp_path / "00" / "gone").symlink_to(tmp_path / "nowhere")
    for levels, parts in ((1, 6), (2, 21), (0, 1)):
        got = cache_indexes.read_cache_folder(spark, str(tmp_path), levels)
        assert got.rdd.getNumPartitions() == parts
        sizes = {r.name: r.size for r in got.collect()}
        assert len(sizes) == 32 and sizes["file7"] == 7 and sizes["top"] == 3


def test_vanished_files_are_rows(tmp_path, monkeypatch):
    (tmp_path / "a").write_text("a")
    (tmp_path / "b").write_text("bb")
    real = os.stat

    def vanishes(path, **more):
        if str(path).endswith("/a"):
            raise FileNotFoundError(2, "No such file or directory")
        return real(path, **more)

    monkeypatch.setattr(cache_folder.os, "stat", vanishes)
    rows = {r[0].rsplit("/", 1)[1]: r[1:] for r in cache_folder.walk(str(tmp_path), True)}
    assert rows["a"] == (None, None, None, "No such file or directory") and rows["b"][0] == 2
    assert [r[4] for r in cache_folder.walk(str(tmp_path / "no"), True)] == ["No such file or directory"]


def test_probe_logs(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        "timestamp,status_code,response_time,size_bytes,url\nDay 1: start\n"
        "2025-06-05 10:11:12,200,0.5,10,https://h.example/a?x=1,2\n"
        "2025-06-05 10:11:13,FAILED,0,0,https://h.example/b\n")
    got = probes.read_probe_csv(spark, str(tmp_path / "p.csv")).collect()
    assert [(r.status_code, r.url) for r in got] == [
        ("200", "https://h.example/a?x=1,2"), ("FAILED", "https://h.example/b")]
    (tmp_path / "p.txt").write_text("200 0.25 https://h.example/a\n000 1.0 https://h.example/b\n")
    assert [(r.status, r.time_total) for r in probes.read_probe_text(
        spark, str(tmp_path / "p.txt")).collect()] == [(200, 0.25), (0, 1.0)]


def test_ranges_are_inclusive(spark):
    ranges = spark.createDataFrame([("trending", "https://o.example/i_%d.jpg", 0, 9)],
                                   "group string, template string, start int, end int")
    got = catalogue.urls_of_ranges(ranges, "https://o.example", "https://c.example").collect()
    assert len(got) == 10 and got[9].url == "https://c.example/i_9.jpg"
