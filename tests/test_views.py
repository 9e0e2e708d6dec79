import datetime as dt

import pytest
from pyspark.sql import functions as F

import clinical_views as views
from cohortspark.operators import windows
from cohortspark.sources import io
from study_queries import QUERIES

EVENTS = [name for name in views.STUDY if name not in ("hospitalization", "hospital_diagnosis")]


@pytest.fixture
def tables(spark, tmp_path):
    """Lines without an order, without a key, repeated lines and a repeated order."""
    day = dt.datetime(1998, 1, 5)
    lines = [(i % 40, i * 7, i * 3, 1 + i % 7, "RAN"[i % 3], "FO"[i % 2], i % 11 / 100) for i in range(400)]
    lines += [*lines[:20], (None, 1, 1, 1, "R", "F", 0.1), (999, 1, 1, 1, "R", "F", 0.1)]
    orders = [(i, i % 5, day + dt.timedelta(days=i), "F", "1-URGENT") for i in range(38)] + [(3, 1, day, "O", None), (None, 1, day, "O", None)]
    spark.createDataFrame(
        lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_returnflag string, l_linestatus string, l_discount double"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(
        orders, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderstatus string, o_orderpriority string"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_views_are_the_same_on_the_stored_join(spark, tables):
    lines = views.stored_lines(spark, tables)
    for name in EVENTS:
        own, plain = views.spark_view(spark, tables, name, lines), views.spark_view(spark, tables, name)
        assert own.schema == plain.schema
        assert sorted(map(str, own.collect())) == sorted(map(str, plain.collect())), name


def test_views_on_the_stored_join_move_no_event(spark, tables):
    lines = views.stored_lines(spark, tables)
    anchors = io.materialize(spark.createDataFrame([(i, dt.datetime(1998, 1, 7)) for i in range(0, 30, 2)], "hospitalization_id bigint, first_icu_in timestamp_ntz"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        events = views.spark_view(spark, tables, "labs", lines).withColumn("kind", F.lit("lab"))
        rows = windows.anchored_rows(events, anchors, "lab_result_dttm")
        joined = rows.groupBy("hospitalization_id").count()
        text = joined._jdf.queryExecution().executedPlan().toString()
        # only the anchors move to where the lines lie
        assert text.count("Exchange hashpartitioning(hospitalization_id") == text.count("Exchange ") <= 2
        counted = {r[0]: r[1] for r in joined.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain = windows.anchored_rows(views.spark_view(spark, tables, "labs"), anchors, "lab_result_dttm").groupBy("hospitalization_id").count()
    assert counted and counted == {r[0]: r[1] for r in plain.collect()}


def test_an_order_with_very_many_lines_is_not_laid_out(spark, tables, monkeypatch):
    monkeypatch.setattr(views, "hot_parts", lambda events, key: windows.hot_parts(events, key, part_rows=5))
    assert views.stored_lines(spark, tables) is None


def test_buckets_grow_with_the_rows(spark):
    small, large = spark.range(100), spark.range(1000)
    assert io.bucket_count([small], 50) == io.LEAST_BUCKETS
    assert io.bucket_count([small, large], 50) == 20 and io.bucket_count([large, small], 30) == 34


def test_fillers_join_the_stored_anchors_where_they_lie(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = QUERIES["optional_block_fillers"](spark, sf_dir)
        text = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and "l_orderkey" not in text
        rows = frame.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    ids = [r.hospitalization_id for r in rows]
    assert ids and len(ids) == len(set(ids)) and all(r.any_imv == r.fever_flag == 0 and r.max_fio2 is None for r in rows)
