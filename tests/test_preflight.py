"""Reasons against a fit, one at a time."""

import pytest
from pyspark.sql import functions as F

from eventloom.operators import preflight
from eventloom.plans import catalogue

QC = "array<struct<name:string,required:boolean,status:string,percent:double,acknowledged:boolean>>"
REGIONS = "struct<g1_left:double,g1_right:double,g2_left:double,g2_right:double>"
SCHEMA = f"s string, mask_retained long, rejected long, seen_fingerprint string, regions {REGIONS}, reviewed boolean, stale boolean, channel string, eligibility string, transforms int, qc {QC}, config map<string,double>"
FIT = {"mask_retained": 200, "rejected": 50, "seen_fingerprint": None, "regions": (0.0, 40.0, 50.0, 90.0), "reviewed": True, "stale": False, "channel": "DNA-A", "eligibility": None, "transforms": 0, "qc": [("structural", True, "applied", 50.0, None)], "config": {"cv": 0.05}}
CASES = [
    ({}, []), ({"rejected": 51}, ["dna_ineligible"]), ({"seen_fingerprint": "other"}, ["histogram_stale"]), ({"regions": None}, ["regions_missing"]), ({"regions": (0.0, 60.0, 50.0, 90.0)}, ["constraint_invalid"]),
    ({"reviewed": None}, ["regions_unreviewed"]), ({"stale": True}, ["regions_stale"]), ({"channel": None}, ["dna_ineligible"]), ({"eligibility": "logarithmic", "transforms": 3}, ["logarithmic"]), ({"transforms": 1}, ["fcs_transform_state_invalid"]),
    ({"regions": (0.0, 1.0, 50.0, 90.0)}, ["peak_support_insufficient"]), ({"qc": [("time", True, "degraded", 1.0, None)]}, ["qc_not_passed"]), ({"qc": [("time", False, "cancelled", 1.0, None)]}, ["qc_not_passed"]), ({"qc": [("time", False, "skipped", 1.0, None)]}, []),
    ({"qc": [("time", True, None, 1.0, None)]}, ["qc_not_passed"]), ({"qc": [("time", True, "waived", 51.0, False)]}, ["qc_critical_removal"]), ({"qc": [("time", True, "waived", 51.0, True)]}, []), ({"qc": []}, []), ({"config": {"cv": float("inf")}}, ["configuration_invalid"]), ({"config": None}, ["configuration_invalid"]), ({"config": {}}, []),
]


def test_each_reason(spark):
    names = SCHEMA.split(", ")
    order = [n.split(" ")[0] for n in names[1:]]
    rows = [(f"s{k}", *[(FIT | change)[c] for c in order]) for k, (change, _) in enumerate(CASES)] + [("none", *[FIT[c] for c in order])]
    bins = spark.range(len(CASES)).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("bin")).withColumns({"left": F.col("bin") * 10.0, "right": F.col("bin") * 10.0 + 10, "count": F.lit(20)})
    got = {r.s: (r.passed, list(r.reasons), r.retained) for r in preflight.preflight(bins, spark.createDataFrame(rows, SCHEMA), "s").collect()}
    for k, (change, reasons) in enumerate(CASES):
        assert got[f"s{k}"] == (not reasons, reasons, 200), change
    assert got["none"] == (False, ["histogram_missing"], 0)


def test_few_events_and_bins(spark):
    order = [n.split(" ")[0] for n in SCHEMA.split(", ")[1:]]
    bins = spark.createDataFrame([("a", k, 10.0 * k, 10.0 * k + 10, c) for k, c in enumerate([20, 30, 0, 0, 0, 30, 15])] + [("b", 0, 0.0, 10.0, -1)], "s string, bin int, left double, right double, count long")
    got = {r.s: set(r.reasons) for r in preflight.preflight(bins, spark.createDataFrame([(s, *[FIT[c] for c in order]) for s in "ab"], SCHEMA), "s").collect()}
    assert got["a"] == {"events_insufficient", "histogram_support_insufficient"} and {"histogram_invalid", "events_insufficient"} <= got["b"]


def test_fingerprints_follow_the_bins(spark):
    bins = spark.createDataFrame([("a", 0, 0.0, 1.0, 5), ("a", 1, 1.0, 2.0, 6), ("b", 1, 1.0, 2.0, 6), ("b", 0, 0.0, 1.0, 5), ("c", 0, 0.0, 1.0, 5), ("c", 1, 1.0, 2.0, 7)], "s string, bin int, left double, right double, count long")
    got = {r.s: r.fingerprint for r in preflight.histogram_fingerprint(bins, "s").collect()}
    assert got["a"] == got["b"] != got["c"]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_the_singlet_gate_is_fitted_and_keeps_events(spark, sf):
    rows = catalogue.QUERIES["ridge_fit"](spark, sf).collect()
    assert rows and all(r.status == "fitted" and 0.5 * r.n < r.kept < r.n for r in rows), rows
