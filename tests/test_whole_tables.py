"""Queries that take every row of their table, against values computed here."""

from eventloom.plans import catalogue

SF = "/root/testdata/sf0.01"


def test_timepoint_rank_covers_every_customer(spark):
    keys = [r.c_custkey for r in spark.read.parquet(SF + "/customer.parquet").select("c_custkey").collect()]
    ordered = sorted(keys, key=lambda k: (float("inf") if k % 7 == 0 else k % 50, k))
    got = {r.c_custkey: r.rank for r in catalogue.QUERIES["timepoint_sort_rank"](spark, SF).collect()}
    assert got == {k: n + 1 for n, k in enumerate(ordered)} and len(got) > 500


def test_pivot_has_every_segment(spark):
    cells = {(r.c_nationkey, r.c_mktsegment) for r in spark.read.parquet(SF + "/customer.parquet").collect()}
    got = catalogue.QUERIES["phase_fractions_pivot"](spark, SF).collect()
    assert {(r["sample"], c) for r in got for c, v in r.asDict().items() if c != "sample" and v is not None} == cells
