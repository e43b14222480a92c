"""What a row costs: expressions that must not be copied or left uncompiled, and the same rows as the plain form."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from edgetide.checks.models import _bundle, model_listing
from edgetide.functions import fixed_values as fixed
from edgetide.functions import paths
from edgetide.operators import cleaning, models, trace


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_computed_id_is_parsed_once(spark, tmp_path):
    """A parsed id was worked out again for every filter that names it, before the cheap filters."""
    rows = [(i, ['{"k": "a.jpg"}', '{"k": ""}', '{"k": "nan"}', "{}", None][i % 5], [200, 304, 404][i % 3],
             ["Mozilla", "Googlebot", None][i % 7 % 3]) for i in range(210)]
    spark.createDataFrame(rows, "id long, props string, status int, user_agent string").write.parquet(f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log").withColumn("file_id", F.get_json_object("props", "$.k"))
    found = cleaning.usable(log)
    assert plan(found).count("get_json_object") == 1
    plain = cleaning.named_objects(cleaning.ok_only(cleaning.without_bots(log)))
    assert found.columns == plain.columns
    assert sorted(found.collect()) == sorted(plain.collect()) and 0 < plain.count() < 210


def test_class_of_an_id_holds_its_path_once(spark, tmp_path):
    spark.range(1).select(F.lit("a.jpg").alias("file_id")).write.parquet(f"{tmp_path}/ids")
    ids = spark.read.parquet(f"{tmp_path}/ids")
    assert plan(ids.select(paths.content_class(F.col("file_id")).alias("type"))).count("substring_index") == 1


def test_look_ahead_over_blocks_without_lambdas(spark):
    """Fewer next accesses in the block than are looked at, so later blocks fill them up."""
    start, names = datetime(2024, 1, 1), [f"o{i * i % 11 % 4}" for i in range(120)]
    frame = spark.createDataFrame([(i, start + timedelta(seconds=i), n) for i, n in enumerate(names)],
                                  "event_id long, ts timestamp_ntz, file_id string")
    for future, window, blocks in ((1, 5, 40), (5, 12, 40), (5, 9, 3), (8, 40, 60)):
        got = trace.look_ahead(trace.positioned(frame, "event_id", blocks=blocks), window, future)
        assert "lambda" not in plan(got.select("future_reuse_prob"))
        for r in got.collect():
            gaps = [j - r.event_id for j in range(r.event_id + 1, 120) if names[j] == r.file_id][:future]
            prob = 0.0
            for g in gaps:
                prob += 1.0 / g if g <= window else 0.0
            assert r.future_reuse_prob == min(prob, 1.0)
            assert r.next_access_distance == (gaps[0] if gaps else 3 * window)
            assert r.will_be_accessed_in_n == int(bool(gaps) and gaps[0] <= window)


def test_listing_of_whole_fits(spark):
    """The listed models were fitted with the estimator's own parameters, and all of those are listed."""
    sf = "/root/testdata/sf0.001"
    listed = {(r.model, r.name): r.value for r in model_listing(spark, sf).filter("kind = 'best_params'").collect()}
    assert set(listed) == {(kind, n) for kind in models.LABELS for n in fixed.FULL_GRID}
    for kind, model in _bundle(spark, sf).models.items():
        stage = models.estimator(kind)
        assert model.stages[-1].getNumTrees == stage.getMaxIter() == int(listed[kind, "maxIter"])
        assert int(listed[kind, "maxDepth"]) == stage.getMaxDepth()
