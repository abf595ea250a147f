"""Queries of channels, cohort review and text columns against their SQL, and small cases."""

import pytest
from pyspark.sql import functions as F
from test_engine import test_query_equals_sql as compare

from eventloom.functions import text
from eventloom.operators import channels, cohort
from eventloom.plans import catalogue, cohort_catalogue

NAMES = sorted(n for n, f in catalogue.QUERIES.items() if f.__module__ == cohort_catalogue.__name__)


@pytest.mark.parametrize("name", NAMES)
def test_cohort_query_equals_sql(spark, name):
    compare(spark, name)


def test_companions_and_canonical_channels(spark):
    names = ["FL1-A", "FL1-H", "FL1-W", "FL2 Area", "Forward Scatter-Area", "SSC-A", "my time", "HDR-T", "W"]
    params = spark.createDataFrame([(1, k, n) for k, n in enumerate(names)] + [(2, 0, None)], "file int, index int, name string")
    got = {(r["index"], r.h, r.w) for r in channels.companions(params).collect()}
    assert got == {(0, 1, 2), (3, None, None), (4, None, None), (5, None, None)}
    assert {tuple(r) for r in channels.canonical(params).collect()} == {(1, 4, 5, 7), (2, None, None, None)}


def test_regions_and_outcomes(spark):
    rows = [("a", 1, 100.0, 10.0, 14.0, 22.0, 28.0), ("a", 2, 200.0, 20.0, 28.0, 44.0, 56.0), ("b", 1, 100.0, 10.0, 14.0, 22.0, 28.0)]
    df = spark.createDataFrame(rows, "k string, i int, range double, g1_left double, g1_right double, g2_left double, g2_right double")
    (r,) = cohort.shared_regions(df, "k", "i").collect()
    assert (r.k, r.samples) == ("a", 2) and [round(x, 9) for x in r[2:]] == [10, 14, 22, 28]
    bad = spark.sql("SELECT named_struct('g1_left', 5D, 'g1_right', 4D, 'g2_left', double('nan'), 'g2_right', 9D) AS r").select(cohort.invalid_region_keys(F.col("r")).alias("k")).first().k
    assert set(bad) == {"g1_left", "g1_right", "g2_left"}  # no end is out of order with NaN


def test_text_columns(spark):
    df = spark.createDataFrame([("x_76aN t55_1.fcs",), ("run wt3 t5.fcs",), ("__ab12.fcs",), (None,)], "n string")
    got = [tuple(r.g) if r.g else None for r in df.select(text.guessed_annotations(F.col("n")).alias("g")).collect()]
    assert got[:3] == [("76", "a", "N", "55"), ("wt3", "wt3", "", "5"), ("", "ab12", "", "")]
    value = spark.range(1).select(text.fnv1a(F.array(*[F.lit(ord(c)) for c in "a"])).alias("h"), text.linspace(F.lit(0.0), F.lit(1.0), 3).alias("l")).first()
    assert value.h == 0xE40C292C and value.l == [0.0, 0.5, 1.0]
