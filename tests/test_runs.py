"""Runs of filters with failures, replayed statistics, calibration classes and fits of a cohort."""

import pytest
from pyspark.sql import functions as F

from eventloom.operators import calibration, qcrun, statsplan
from eventloom.operators.qcrun import Filter
from eventloom.plans import run_catalogue

SF = "/root/testdata/sf0.01"


def events(spark):
    rows = [("a", float(x), x % 2) for x in range(10)] + [("b", float(x), 1) for x in range(3)] + [(None, 5.0, 1), ("c", float("nan"), None)]
    return spark.createDataFrame(rows, "s string, x double, odd int")


def filters():
    return [Filter("low", F.col("x") < 8), Filter("parity", F.col("odd") == 1, {"FEW": lambda kept: F.count_if(kept) >= 4}), Filter("high", F.col("x") > 1, {"NONE": lambda kept: F.count_if(kept) > 0, "SPREAD": lambda kept: F.max(F.when(kept, F.col("x"))) > 2})]


@pytest.mark.parametrize("go_on", [True, False])
def test_failed_filters_leave_their_mask_null(spark, go_on):
    masked, steps = qcrun.run(events(spark), "s", filters(), go_on=go_on)
    got = {(r.s, r["name"]): (r.status, r.code, r.entered, r.kept) for r in steps.collect()}
    assert got["a", "low"] == ("applied", None, 10, 8) and got["a", "parity"] == ("applied", None, 8, 4) and got["a", "high"] == ("applied", None, 4, 3)
    assert got["b", "parity"] == ("failed", "FEW", 3, 3)
    assert got["b", "high"] == (("failed", "SPREAD", 3, 3) if go_on else ("not_run", None, 3, 3))
    assert got[None, "high"] == (("applied", None, 1, 1) if go_on else ("not_run", None, 1, 1))
    assert got["c", "low"] == ("applied", None, 1, 0)  # NaN is above every number
    rows = masked.where("s = 'b'").collect()
    assert all(r.parity is None and r.high is None and r.kept for r in rows) and len(rows) == 3
    assert [r.x for r in masked.where("kept and s = 'a'").orderBy("x").collect()] == [3.0, 5.0, 7.0]
    done = {r.s: (r.status, list(r.failed), r.lost) for r in qcrun.completion(steps, "s").collect()}
    assert done["a"] == ("complete", [], 7) and done["b"] == ("incomplete", ["parity", "high"], 0)


def test_runs_without_events_filters_or_with_clashing_names(spark):
    masked, steps = qcrun.run(events(spark).limit(0), "s", filters())
    assert masked.count() == 0 and steps.count() == 0
    masked, steps = qcrun.run(events(spark), "s", [])
    assert masked.where("kept").count() == 15 and steps.count() == 0
    with pytest.raises(ValueError, match="new and different"):
        qcrun.run(events(spark), "s", [Filter("X", F.lit(True))])


def test_ceilings_of_files(spark):
    files = spark.createDataFrame([("a", 100.0, 50.0), ("b", None, 60.0)], "s string, r1 double, r2 double")
    own = {"dna_a": "r1", "dna_h": "r2"}
    got = lambda settings: {r.s: (r.ceiling_dna_a, r.ceiling_dna_h) for r in qcrun.ceilings(files, "s", own, settings).collect()}
    assert got({}) == {"a": (100.0, 50.0), "b": (None, 60.0)}
    assert got({"dna_a": {"override": 7}, "dna_h": {"enabled": False, "override": 3}}) == {"a": (7.0, None), "b": (7.0, None)}
    for wrong in ({"dna_w": {}}, {"dna_a": {"enable": True}}):
        with pytest.raises(ValueError, match="unknown settings"):
            qcrun.ceilings(files, "s", own, wrong)


def test_a_second_replay_reads_new_files_only(spark, tmp_path):
    folder, schema = f"file://{tmp_path}", "s string, x double"
    write = lambda s, xs: spark.createDataFrame([(s, x) for x in xs], schema).toPandas().to_parquet(tmp_path / f"{s}.parquet")
    plan = statsplan.recorded(statsplan.plan_of_columns(spark, ["x:n", "x:median", "y:n", "x:unknown", "name"]), "x", ["max"])
    write("one", [1.0, 2.0, 9.0])
    write("two", [float("nan"), -1.0])
    first = statsplan.replayed_files(spark, folder, schema, "s", plan, statsplan.computed(spark.createDataFrame([], schema), "s", plan))
    rows = first.collect()
    assert {(r.s, r.metric): r.value for r in rows} == {("one", "n"): 3.0, ("one", "median"): 2.0, ("one", "max"): 9.0, ("two", "n"): 0.0, ("two", "median"): None, ("two", "max"): None}
    done = spark.createDataFrame(rows, first.schema)
    (tmp_path / "one.parquet").write_bytes(b"no longer Parquet")
    write("three", [4.0])
    again = statsplan.replayed_files(spark, folder, schema, "s", plan, done)
    assert again.count() == 9 and again.where("s = 'three' and metric = 'max'").first().value == 4.0
    assert statsplan.new_files(spark, folder, again, "s") == []
    with pytest.raises(ValueError, match="unknown metrics"):
        statsplan.recorded(plan, "x", ["mode"])


def test_fingerprints_of_incomplete_axes_are_null(spark):
    rows = [("FL1", 1024.0, "F", 32, None), ("FL1", 1024.0, "F", 32, ""), ("", 1024.0, "F", 32, None), ("FL1", 0.0, "F", 32, None), ("FL1", float("nan"), "F", 32, None), ("FL1", None, "F", 32, None), ("FL1", 1.0, None, 32, None), ("FL1", 1.0, "F", 0, None)]
    df = spark.createDataFrame(rows, "channel string, range double, datatype string, bits int, amplification string")
    axes = [r.a for r in df.select(calibration.fingerprint({c: F.col(c) for c in df.columns}).alias("a")).collect()]
    assert axes[0] == axes[1] and axes[0].amplification == "0,0" and axes[0].spillover == "none" and axes[2:] == [None] * 6


def test_fits_share_regions_of_trusted_samples_of_one_axis(spark):
    found = {r.p_partkey: r for r in run_catalogue.fit_all_outcomes(spark, SF).collect()}
    shared = [r for r in found.values() if r.mode == "shared_median_normalized"]
    assert shared and all(r.included and r.trusted for r in shared) and {r.outcome for r in found.values()} == {"detection_failed", "skipped", "cancelled", "fit_failed", "converged_reportable", "computed_nonconverged"}
    wrong = spark.createDataFrame([("a", "lost", "independent")], "c string, outcome string, mode string")
    with pytest.raises(Exception, match="add up"):
        calibration.accounted(wrong, "c").collect()


def test_waivers_need_a_reason_for_every_open_filter(spark):
    steps = spark.createDataFrame([("a", "time", "failed", "X"), ("a", "cell", "not_run", None), ("b", "time", "failed", "X"), ("c", "time", "applied", None)], "s string, name string, status string, code string")
    waivers = spark.createDataFrame([("a", "time", "known"), ("b", "time", "known"), ("a", "cell", " ")], "s string, name string, reason string")
    got = {(r.s, r["name"]): (r.waiver, r.approved) for r in calibration.waived(steps, waivers, "s").collect()}
    assert got == {("a", "time"): ("known", False), ("a", "cell"): (None, False), ("b", "time"): ("known", True)}


def test_a_mean_that_equals_its_limit_meets_it_in_any_order_of_rows(spark):
    rows = spark.createDataFrame([("a", x) for x in [0.05] * 490 + [0.04] * 5 + [0.05] * 5] + [("b", x) for x in [0.05] * 494 + [0.04] * 6] + [("c", None), ("d", float("nan")), ("e", 1e300)], "s string, x double")
    whole = lambda df: {r.s: r.ok for r in df.groupBy("s").agg(qcrun.mean_at_least(F.col("x"), "0.0499").alias("ok")).collect()}
    assert whole(rows) == whole(rows.coalesce(1).orderBy("x")) == {"a": True, "b": False, "c": None, "d": True, "e": True}
    masked, steps = qcrun.run(rows, "s", [Filter("mean", F.lit(True), {"LOW": lambda kept: qcrun.mean_at_least(F.when(kept, F.col("x")), "0.0499")})])
    assert {r.s: r.status for r in steps.collect()} == {"a": "applied", "b": "failed", "c": "failed", "d": "applied", "e": "applied"}


def test_the_scatter_filter_of_the_query_is_exact(spark):
    rows = spark.createDataFrame([("a", x) for x in [0.02, 0.08] * 247 + [0.04] * 5 + [0.05]], "sample_id string, fsc_a double").coalesce(1).selectExpr("*", "0.05D AS ssc_a")
    steps = qcrun.run(rows, "sample_id", run_catalogue._filters()[2:])[1]
    assert [r.status for r in steps.collect()] == ["applied"] and rows.agg(F.avg("fsc_a")).first()[0] < 0.0499
