"""Cohorts of event files of which some can't be read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.sources import fcs


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("cohort")
    good = fcs.encode(["DNA-A", "Time"], [np.arange(1000.0), np.arange(1000.0) / 2], kind="D")
    (d / "one.fcs").write_bytes(good)
    (d / "two.fcs").write_bytes(fcs.encode(["DNA-A", "FSC-A"], [np.arange(7.0), np.ones(7)]))
    (d / "short.fcs").write_bytes(good[:-5])
    (d / "version.fcs").write_bytes(good.replace(b"FCS3.1", b"ABC3.1"))
    (d / "head.fcs").write_bytes(good[:30])
    (d / "empty.fcs").write_bytes(b"")
    return str(d)


CODES = {"short": "FCS_DATA_TRUNCATED", "version": "FCS_VERSION_UNSUPPORTED", "head": "FCS_HEADER_TRUNCATED", "empty": "FCS_HEADER_TRUNCATED"}


@pytest.mark.parametrize("split", [97, 1 << 20])
def test_good_events_and_a_code_for_each_bad_file(spark, folder, split):
    events, errors = fcs.load_events(spark, folder, split_bytes=split)
    assert set(events.columns) == {"sample_id", "event_index", "DNA-A", "Time", "FSC-A"}
    got = {r.sample_id: r for r in events.groupBy("sample_id").agg(F.count("*").alias("n"), F.countDistinct("event_index").alias("d"), F.max("event_index").alias("m"), F.sum("DNA-A").alias("s"), F.count("Time").alias("t")).collect()}
    assert {k: (r.n, r.d, r.m, r.s, r.t) for k, r in got.items()} == {"one": (1000, 1000, 999, 499500.0, 1000), "two": (7, 7, 6, 21.0, 0)}
    found = [(fcs.sample_name(r.path), r.code) for r in errors.collect()]
    assert sorted(found) == sorted(CODES.items()) and all(r.detail for r in errors.collect())


def test_missing_channels_are_nulls_or_an_error(spark, folder):
    events, errors = fcs.load_events(spark, folder, ["Time"], missing="error", split_bytes=50)
    assert {r.sample_id for r in events.select("sample_id").distinct().collect()} == {"one"}
    assert {fcs.sample_name(r.path): r.code for r in errors.collect()} == CODES | {"two": "FCS_CHANNEL_MISSING"}


def test_without_quarantine_a_bad_file_fails(spark, folder):
    spark.dataSource.register(fcs.FcsSource)
    with pytest.raises(Exception, match="FCS_"):
        spark.read.format("fcs").option("channels", "DNA-A").load(folder).count()


def test_no_readable_file(spark, tmp_path):
    (tmp_path / "x.fcs").write_bytes(b"nothing")
    events, errors = fcs.load_events(spark, str(tmp_path))
    assert events.count() == 0 and [r.code for r in errors.collect()] == ["FCS_HEADER_TRUNCATED"]


def test_written_files_read_back(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") % 3).cast("string").alias("s"), (4999 - F.col("id")).alias("i"), (F.col("id") * 0.1).alias("x"), F.lit(None).cast("double").alias("y"))
    files = fcs.write_events(df, "s", "i", ["x", "y"], f"file://{tmp_path}/out").collect()
    assert {(r["sample"], r.events) for r in files} == {("0", 1667), ("1", 1667), ("2", 1666)}
    events, errors = fcs.load_events(spark, f"file://{tmp_path}/out")
    assert errors.count() == 0
    got = {(r.sample_id, r.event_index): r.x for r in events.collect()}
    want = {}
    for s in range(3):
        want |= {(str(s), k): x for k, x in enumerate(reversed([i * 0.1 for i in range(5000) if i % 3 == s]))}
    assert got == want


def test_offsets_that_do_not_fit_the_header():
    raw = fcs.header(["A"] * 4, 5_000_000, kind="D")
    s = fcs.summarize(lambda at, n: raw[at : at + n], len(raw) + 5_000_000 * 32)
    assert (s.begin, s.end) == (len(raw), len(raw) + 5_000_000 * 32 - 1)


def test_samples_are_written_whole_whatever_becomes_of_the_shuffle(spark, tmp_path):
    """The counts are broadcast once they are seen to be few: nothing else than the writer then asks for a sample in one task."""
    rows = spark.range(0, 40_000, 1, 8).select((F.col("id") % 3).cast("string").alias("s"), F.floor(F.col("id") / 3).alias("i"), F.col("id").cast("double").alias("x"))
    rows = rows.repartition(8, "i")
    conf = {"spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        files = fcs.write_events(rows, "s", "i", ["x"], f"file://{tmp_path}/f")
        plan = files._jdf.queryExecution().optimizedPlan().toString().split("\n")
        assert "MapInArrow" in plan[0] and any("Window" in line for line in plan[1:3])  # which asks for whole samples; a repartition doesn't
        written = files.collect()
        assert sorted((r["sample"], r["events"]) for r in written) == [("0", 13334), ("1", 13333), ("2", 13333)]
        events, errors = fcs.load_events(spark, f"file://{tmp_path}/f")
        assert errors.count() == 0 and events.where("x <> event_index * 3 + cast(sample_id as int)").count() == 0 and events.count() == 40_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        for k in list(conf)[1:]:
            spark.conf.unset(k)
