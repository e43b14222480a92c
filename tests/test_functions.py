"""Edge rows of the column functions."""

import math

import pytest
from pyspark.sql import functions as F

from edgetide.functions import clients, paths, responses, scores
from edgetide.functions import fixed_values as fixed
from edgetide.operators import cleaning, snapshot as snapshots


def values(spark, rows, expression, schema="x string"):
    frame = spark.createDataFrame([(r,) for r in rows], schema).coalesce(1)
    return [r[0] for r in frame.select(expression.alias("y")).collect()]


def x():
    return F.col("x")



def test_extension_and_object_id(spark):
    assert values(spark, ["/a/B.JPG", "/a/b", "/a/a.b.jpg", ""], paths.extension(x())) == [
        "jpg", "/a/b", "jpg", ""]
    assert values(spark, ["/a/a.b.jpg", "plain", "/a/"], paths.object_id(x())) == ["a", "plain", ""]


def test_media_type_hides_behind_query_string(spark):
    rows = ["/a.jpg?v=1", "/a.webm", "/a.css"]
    assert values(spark, rows, paths.media_type(x())) == ["other", "video", "other"]
    assert values(spark, rows, paths.media_type(x(), strip_query=True)) == ["image", "video", "other"]


def test_content_class(spark):
    rows = ["http://h.example/a/b.png?x=a.mp3", "http://h.example/path", "x.7z", "x.unknown", None,
            "video_1"]
    assert values(spark, rows, paths.content_class(x())) == [
        "image", "unknown", "archive", "other", "unknown", "unknown"]


def test_labels_strict_and_lenient(spark):
    rows = ["image", "video", "PNG", "javascript", "nothing", None]
    assert values(spark, rows, paths.class_of_label(x(), strict=True)) == [
        "other", "other", "image", "javascript", "other", "unknown"]
    assert values(spark, rows, paths.class_of_label(x())) == [
        "image", "video", "image", "javascript", "other", "unknown"]


def test_class_ordinals_cover_all_and_default(spark):
    rows = [*fixed.CLASS_ORDINAL, "nothing", None]
    assert values(spark, rows, paths.class_ordinal(x())) == [*range(12), 11, 11]


def test_clients_and_bots(spark):
    rows = ["Mobile Tablet", "my iPad", "Edge", "curl/8", None, "DuckDuckBot"]
    assert values(spark, rows, clients.client_class(x())) == [
        "mobile", "tablet", "desktop", "other", "unknown", "other"]
    assert values(spark, rows, clients.is_bot(x())) == [False, False, False, True, False, True]


def test_hash_guess_and_cached_path(spark):
    digest = "1c097e982eea7d7a5c40529e129e90fc"
    assert values(spark, [digest], responses.cached_path_of_hash(x())) == [f"fc/90/{digest}"]
    assert values(spark, [f"fc/90/{digest}", f"fc/90/{digest}.000012", ".hidden", "a.b.c"],
                  responses.hash_of_cached_path(x())) == [digest, digest, ".hidden", "a.b"]


def test_routes(spark):
    rows = ["/static/images/a.jpg", "/STATIC/videos/b.mp4", "/.git/x", "/.well-known/x",
            "/app/env.json", "/health", "/images/popular"]
    assert values(spark, rows, paths.route_class(x())) == [
        "static_media", "static_media", "hidden", "page", "env_file", "health", "page"]


def test_load_bands_use_the_evident_intent(spark):
    assert values(spark, [0, 6, 7, 9, 11, 12, 15, 18, 23], responses.load_multiplier(x()), "x int") == [
        0.3, 0.3, 0.8, 1.5, 1.5, 1.2, 1.8, 2.0, 1.0]


def test_count_estimates(spark):
    days = F.lit(40.0)
    assert values(spark, [None, 0, 7], scores.count_or_age_estimate(x(), days), "x bigint") == [5, 5, 7]
    media = scores.estimated_count_by_age_and_size(F.lit("image"), F.lit(3.0), x())
    assert values(spark, [0, 200 * 1024 * 1024], media, "x bigint") == [1, 21]
    early = scores.estimated_count_by_age_and_size(F.lit("css"), F.lit(-5.0), x())
    assert values(spark, [0], early, "x bigint") == [1]


def test_decay_keeps_drops_and_fades(spark):
    assert values(spark, [0.5], scores.decayed(F.lit(4.0), x()), "x double") == [4.0]
    assert values(spark, [2.0], scores.decayed(F.lit(4.0), x()), "x double") == [
        pytest.approx(4 * 0.99 ** 2)]
    assert values(spark, [2.0], scores.decayed(F.lit(0.1), x()), "x double") == [None]


def test_belady_edge_cases(spark):
    half = scores.belady_score("distance", F.lit(0.1), F.lit(0.0), F.lit(0.5), x())
    assert values(spark, [0.0], half, "x double") == [0.5]
    no_distance = scores.belady_score("lrb", F.lit(0.5), F.lit(0.0), F.lit(0.5), x())
    assert values(spark, [0.0], no_distance, "x double") == [pytest.approx(0.2 + 0.1)]
    with pytest.raises(ValueError):
        scores.belady_score("best", x(), x(), x(), x())


def test_scores_of_broken_rows(spark):
    assert values(spark, [None], scores.lru_score(x(), F.lit(1), F.lit(1)), "x double") == [999999.0]
    assert values(spark, [None], scores.lfu_score(F.lit(1.0), x(), F.lit(1), F.lit(1)),
                  "x double") != [None]


def test_age_may_be_negative_and_is_exact(spark):
    row = spark.sql("select timestamp_ntz'2024-01-01 00:00:00.000001' as ts")
    assert row.select(scores.age_seconds(F.col("ts"), "2024-01-01 00:00:01")).first()[0] == 0.999999
    assert row.select(scores.age_seconds(F.col("ts"), "2023-12-31 23:59:59")).first()[0] == -1.000001


def test_model_row_fills_every_default(spark):
    row = snapshots.model_row(spark.createDataFrame([("a",)], "file_id string")).first()
    assert row.stack_distance_approx == 1000.0 and row.type_encoded == 11 and row.access_count == 1
    assert row.log_file_size == 0.0
    sized = snapshots.model_row(spark.createDataFrame([("a", 9)], "file_id string, size bigint")).first()
    assert sized.log_file_size == pytest.approx(math.log(10))


def test_alphabetical_code_counts_only_present_values(spark):
    rows = spark.createDataFrame([("video",), ("image",), ("video",)], "type string")
    assert {r.type: r.code for r in snapshots.alphabetical_code(rows, "type").collect()} == {
        "image": 0, "video": 1}


def test_success_is_tested_on_the_status_column(spark):
    probes = spark.createDataFrame(
        [("404", 250), ("200", 1), ("FAILED", 200), ("RETRY_1", 0), ("3000", 1)],
        "status_code string, size_bytes int")
    assert [r[0] for r in cleaning.successful(probes).collect()] == ["200"]
    assert {r[0] for r in cleaning.accept_or_retry(probes).collect()} == {"200", "404"}
    assert {r[0] for r in cleaning.failed_or_retried(probes).collect()} == {"FAILED", "RETRY_1"}


def test_valid_entries(spark):
    rows = spark.createDataFrame(
        [("a", "2025-06-05T10:11:12", 1), ("b", None, 1), ("c", "soon", 1), ("d", "2025-06-05T10:11:12", 0),
         ("e", "2025-06-05T10:11:12", -4)], "file_id string, last_access string, size bigint")
    assert [r.file_id for r in cleaning.valid_entries(rows).collect()] == ["a"]
