"""What a sample has of its own reaches its events without the sample in one task."""

import pytest
from pyspark.sql import functions as F

from eventloom.operators import gates, statsplan
from eventloom.operators.beside import beside
from eventloom.operators.ranking import quantiles
from eventloom.plans import catalogue


@pytest.fixture
def joins_by_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def events(spark):
    return spark.range(20_000).select(F.lit("one").alias("s"), F.col("id").cast("double").alias("x"), (F.col("id") % 777).cast("double").alias("y"))


def test_a_group_is_dealt_over_tasks(joins_by_shuffle):
    spark = joins_by_shuffle
    own = spark.createDataFrame([("one", 1), ("two", 2), (None, 3)], "s string, v int")
    got = beside(events(spark), own, "s", ["x"])
    assert got.count() == 20_000 and max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) < 12_000
    rows = spark.createDataFrame([("one", 1.0), (None, 2.0), ("three", 3.0)], "s string, x double")
    found = lambda **k: {r.x for r in beside(rows, own, "s", ["x"], **k).collect()}
    assert found() == {1.0} and found(null_safe=True) == {1.0, 2.0} and found(how="left") == {1.0, 2.0, 3.0}
    assert found(how="left_anti") == {2.0, 3.0} and found(how="left_anti", null_safe=True) == {3.0}


def test_no_join_sorts_a_sample(joins_by_shuffle):
    df = events(joins_by_shuffle)
    middle = quantiles(df, "s", ["x", "y"], [0.5])
    assert {r.column: r.q for r in middle.collect()} == {"x": 9999.5, "y": 384.0}
    asked = statsplan.plan_of_columns(joins_by_shuffle, ["x:n"])
    done = joins_by_shuffle.createDataFrame([("two",)], "s string").select("s", F.lit("x").alias("channel"), F.lit("").alias("mask"), F.lit("n").alias("metric"), F.lit(0.0).alias("value"))
    replayed = statsplan.replayed(df, "s", asked, done)
    assert {(r.s, r.value) for r in replayed.collect()} == {("one", 20_000.0), ("two", 0.0)}
    fits = gates.fit_singlets(df, "s", "x", "y")
    for found, least in ((middle, 1), (fits, 1), (gates.apply_singlets(df, fits, "s", "x", "y"), 2), (gates._pulse_evidence(df, "s", "x", "y", 1), 2)):
        assert plan(found).count("ShuffledHashJoin") >= least
    assert "ShuffledHashJoin" in plan(statsplan.replayed(df, "s", asked, done)) and "SortMergeJoin" not in plan(gates.apply_singlets(df, fits, "s", "x", "y"))


def test_status_of_a_sample_is_no_reason_to_sort_its_events(spark):
    assert "SortAggregate" not in plan(catalogue.ridge_fit(spark, "/root/testdata/sf0.01"))
