"""Every registered query against its SQL, and the shape of the plans."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, tables, name):
    assert compare(spark, tables, QUERIES[name], SQL.get(name), SF) == ""


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["file_id", "requests", "bytes_sent"] and 0 < frame.count() <= 20


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


PLANNED = [n for n in QUERIES if not n.startswith(
    ("running_", "streamed_", "late_", "json_", "parameter_", "model_", "learned_"))]


@pytest.mark.parametrize("name", PLANNED[::6])
def test_no_pairing_joins(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    from edgetide.operators import content
    from edgetide.sources import catalogue
    from edgetide.checks import views
    from edgetide.staging import new_path
    path = new_path(spark, "content")
    views.content(spark, SF).write.parquet(path)
    frame = content.of_group(catalogue.read_content(spark, path), "image", "popular").select("id")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(group,popular)" in plan and "EqualTo(content_type,image)" in plan
    assert "filename" not in plan.split("ReadSchema")[1]
