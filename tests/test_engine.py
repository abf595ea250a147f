import math
import os
import tempfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions import columns as C
from eventloom.operators import bridge, fitstats, gates, metadata, models, peaktrack, samples, series, timeqc
from eventloom.operators.ranking import indexed, quantiles
from eventloom.plans import catalogue
from eventloom.sources import fcs, tables
from eventloom.streaming import cohort

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "~"
        return repr(round(float(v), 4)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({catalogue.SQL[name]})").fetchall()
    assert plain(tuple(r) for r in got.select(*[f"`{n}`" for n in names]).collect()) == plain(want)


def test_quantiles_of_few_equal_and_odd_values(spark):
    rows = [("a", float(x)) for x in (1, 2, 3, 10)] + [("b", 5.0)] * 3 + [("c", float("nan")), ("c", 7.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {(r.k, r.p): r.q for r in quantiles(df, "k", "x", [0.25, 0.5, 1.0]).collect()}
    assert got == {("a", 0.25): 1.75, ("a", 0.5): 2.5, ("a", 1.0): 10.0, **{("b", p): 5.0 for p in (0.25, 0.5, 1.0)}, **{("c", p): 7.0 for p in (0.25, 0.5, 1.0)}}


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.lognormal(size=3001)
    df = spark.createDataFrame([("a", float(v)) for v in x], "k string, x double")
    got = [r.q for r in quantiles(df, "k", "x", [0.01, 0.3, 0.99], accuracy=64).orderBy("p").collect()]
    assert np.allclose(got, np.quantile(x, [0.01, 0.3, 0.99]))


def test_indexed_is_dense(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7).alias("o"))
    assert all(sorted(r.i) == list(range(len(r.i))) for r in indexed(df, "k", "o", "i", block=100).groupBy("k").agg(F.collect_list("i").alias("i")).collect())


def test_empty_and_nonfinite_samples(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", -1.0), ("b", float("inf")), ("b", 2.0)], "k string, x double")
    got = {r.k: (r.n, r["median"]) for r in samples.column_stats(df, "k", "x").collect()}
    assert got == {"a": (0, None), "b": (1, 2.0)}
    assert samples.column_stats(df.limit(0), "k", "x").count() == 0
    assert samples.histogram(df.limit(0), "k", "x", 4).count() == 0
    h = samples.histogram(df.where("x = 2"), "k", "x", 4).collect()
    assert sum(r["count"] for r in h) == 1 and len(h) == 4


def test_masks(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), True), (-1.0, True), (99.0, False), (5.0, True)], "x double, m boolean")
    got = [r[0] for r in df.select(samples.structural_mask({"x": 50.0})).collect()]
    assert got == [True, False, False, False, True]
    assert [r[0] for r in df.select(samples.combined(F.col("m"), F.lit(None).cast("boolean"))).collect()] == [True, True, True, False, True]


def test_segments_and_wraps(spark):
    times = [10.0, 90.0, 5.0, 20.0, 3.0, None, 4.0]  # 90 -> 5 wraps at 100; 20 -> 3 goes back
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(times)], "k string, i int, t double")
    got = [(r.segment, r.unwrapped) for r in timeqc.segments(df, "k", "i", "t", 100.0).orderBy("i").collect()]
    assert got == [(0, 10.0), (0, 90.0), (0, 105.0), (0, 120.0), (1, 3.0), (None, None), (2, 4.0)]


def test_names(spark):
    names = ["A10.fcs", "a2.FCS", "b1", "a1.fcs"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.orderBy(*metadata.sort_keys("n", "n")).collect()] == ["a1.fcs", "a2.FCS", "A10.fcs", "b1"]
    row = df.limit(1).select(C.filename_key(F.lit("C:\\x\\ A10.FCS")), C.measurement_kind(F.lit("DNA Area")), C.measurement_base(F.lit("FL2-A")), C.normalized_keyword(F.lit(" $p1n x")), C.first_decimal(F.lit("t-2.5h"))).first()
    assert tuple(row) == ("a10", "a", "fl2", "P1N_X", -2.5)
    parts = df.limit(1).select(*C.split_name(F.lit("WT_03 x"), [("delimiter", "_"), ("fixed", 2), ("regex", "(y)")])).first()
    assert tuple(parts) == ("WT", "03", " x", "")
    assert metadata.unique_label("Strain", ["strain", "Strain 2"]) == "Strain 3" and metadata.field_name("Time point", ["timePoint"]) == "timePoint2"


def test_links(spark):
    records = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "")], "o int, key string")
    files = spark.createDataFrame([(7, "a"), (8, "a"), (9, "c")], "n int, key string")
    assert {(r.o, r.link, r.file) for r in metadata.linked(records, files, "key", "o", "n").collect()} == {(1, "matched", 7), (2, "duplicate", None), (3, "unmatched", None), (4, "empty", None)}
    late = metadata.late_linked(spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, "a", None)], "o int, key string, file int"), spark.createDataFrame([("a", 6)], "key string, new_file int"), "key", "o")
    assert {(r.o, r.file) for r in late.collect()} == {(1, 5), (2, 6), (3, None)}


@pytest.mark.parametrize("kind,little,bits", [("F", True, None), ("F", False, None), ("D", True, None), ("I", True, [8, 16, 24]), ("I", False, [32, 40, 48])])
def test_fcs_round_trip(spark, kind, little, bits):
    rng = np.random.default_rng(2)
    columns = [rng.integers(0, 200, 50).astype(float) for _ in range(3)]
    with tempfile.TemporaryDirectory() as d:
        for name in ("b.fcs", "a.fcs"):
            with open(os.path.join(d, name), "wb") as f:
                f.write(fcs.encode(["DNA-A", "FSC/A", "Time"], columns, kind=kind, little=little, bits=bits))
        spark.dataSource.register(fcs.FcsSource)
        got = spark.read.format("fcs").option("channels", "Time,DNA-A").option("split_bytes", 200).load(d + "/*.fcs").where("sample_id = 'a'").orderBy("event_index").toPandas()
        assert np.allclose(got["Time"], columns[2]) and np.allclose(got["DNA-A"], columns[0]) and list(got["event_index"]) == list(range(50))
        head = spark.read.format("fcs").option("mode", "header").load(d + "/*.fcs").collect()
        assert [h.labels for h in head] == [["DNA-A", "FSC/A", "Time"]] * 2 and head[0].eligibility == ["linear"] * 3


@pytest.mark.parametrize("change,code", [((b"FCS3.1", b"XCS3.1"), "FCS_VERSION_UNSUPPORTED"), ((b"$DATATYPE/F", b"$DATATYPE/A"), "FCS_DATATYPE_UNSUPPORTED"), ((b"1,2,3,4", b"3,1,4,2"), "FCS_BYTE_ORDER_UNSUPPORTED"), ((b"$TOT/9", b"$TOT/8"), "FCS_DATA_LENGTH_MISMATCH"), ((b"$TOT/9", b"$TOT/x"), "FCS_METADATA_INVALID")])
def test_fcs_faults(spark, change, code):
    raw = fcs.encode(["A", "B", "C"], [np.arange(9.0)] * 3).replace(*change)
    with pytest.raises(fcs.FcsError) as e:
        fcs.summarize(lambda at, n: raw[at : at + n], len(raw))
    assert e.value.code == code
    with pytest.raises(fcs.FcsError) as e:
        fcs.summarize(lambda at, n: raw[:40][at : at + n], 40)
    assert e.value.code == "FCS_HEADER_TRUNCATED"


def test_tables_and_sessions(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('﻿File name\tnote\na.fcs\t"x ""y"""\nb.fcs\t\n')
    df = tables.read_table(spark, str(tmp_path / "t.tsv"))
    assert tables.filename_column(df) == "File name" and [tuple(r) for r in df.collect()] == [("a.fcs", 'x "y"'), ("b.fcs", "")]
    session = {"session": {"version": 1}, "plot": {"bins": 256, "on": True, "names": ["a", 'b"c']}}
    assert tables.read_session(tables.write_session(session)) == session
    with pytest.raises(ValueError):
        tables.read_session("[evil]\nx = 1\n")
    cells = spark.createDataFrame([("=1+1",), (" +x",), ("ok",), ("a\tb",), (None,)], "v string").select(C.tsv_cell(F.col("v"))).collect()
    assert [r[0] for r in cells] == ["'=1+1", "' +x", "ok", '"a\tb"', ""]


def test_gates_recover_the_main_cloud(spark):
    rng = np.random.default_rng(3)
    main = rng.multivariate_normal([100, 50], [[40, 20], [20, 30]], 3000)
    debris = rng.multivariate_normal([20, 10], [[20, 0], [0, 20]], 900)
    rows = [("a", float(x), float(y), k) for k, part in (("m", main), ("d", debris)) for x, y in part] + [("b", 1.0, 1.0, "m")] * 3
    df = spark.createDataFrame(rows, "s string, x double, y double, kind string")
    fits = gates.fit_scatter(df, "s", "x", "y")
    assert {(r.s, r.status) for r in fits.collect()} == {("a", "fitted"), ("b", "skipped")}
    got = {(r.s, r.kind): r.share for r in gates.apply_scatter(df, fits, "s", "x", "y").groupBy("s", "kind").agg(F.avg(F.col("scatter_ok").cast("int")).alias("share")).collect()}
    assert got["a", "m"] > 0.9 and got["a", "d"] < 0.02 and got["b", "m"] is None


def test_singlet_gate_drops_doublets(spark):
    rng = np.random.default_rng(4)
    area = rng.normal(100, 15, 2000)
    single = np.stack([area, area * 0.5 + rng.normal(0, 1, 2000)], axis=1)
    double = np.stack([rng.normal(200, 10, 200), rng.normal(52, 3, 200)], axis=1)
    df = spark.createDataFrame([("a", float(x), float(y), k) for k, p in (("s", single), ("d", double)) for x, y in p], "s string, x double, y double, kind string")
    fits = gates.fit_singlets(df, "s", "x", "y")
    got = {r.kind: r.share for r in gates.apply_singlets(df, fits, "s", "x", "y").groupBy("kind").agg(F.avg(F.col("singlet_ok").cast("int")).alias("share")).collect()}
    assert got["s"] > 0.97 and got["d"] < 0.2


@pytest.mark.parametrize("fractions", [(0.7, 0.2, 0.1), (0.5, 0.3, 0.2), (0.25, 0.55, 0.2)])
@pytest.mark.parametrize("model,tolerance", [("dean_jett", 0.04), ("auto", 0.06), ("watson_pragmatic", 0.2)])
def test_models_recover_fractions(spark, fractions, model, tolerance):
    rng = np.random.default_rng(5)
    n = [int(12000 * f) for f in fractions]
    x = np.concatenate([rng.normal(100, 5, n[0]), rng.uniform(100, 200, n[1]) * rng.normal(1, 0.05, n[1]), rng.normal(200, 10, n[2])])
    df = spark.createDataFrame([("a", float(v)) for v in x], "s string, x double")
    h = models.arrays(samples.histogram(df, "s", "x", 256, low=0.0, high=300.0), "s")
    pairs = models.detected_peaks(h, "s")
    p = pairs.first()
    assert p.status == "detected" and abs(p.g1 - 100) < 4 and abs(p.g2 - 200) < 8
    r = models.fitted(h, pairs, "s", model).first()
    assert max(abs(a - b) for a, b in zip((r.phase_g1, r.phase_s, r.phase_g2), fractions, strict=True)) < tolerance
    assert fitstats.reportable(models.fitted(h, pairs, "s", model)).first().valid == (model != "watson_pragmatic")


def test_models_without_input(spark):
    h = spark.createDataFrame([("a", 0.0, 1.0, [1.0] * 8)], "s string, low double, width double, counts array<double>")
    pairs = models.detected_peaks(h, "s")
    assert pairs.first().status == "none"
    assert models.fitted(h, pairs, "s").first().reasons == ["few_events", "no_regions"]


def test_streamed_stats_equal_batch(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([("a", float(k)), ("b", float(k * k))], "s string, x double").write.mode("append").parquet(str(tmp_path / "in"))
    q = cohort.running_stats(cohort.arriving(spark, str(tmp_path / "in"), "s string, x double", 1), "s", "x").writeStream.outputMode("complete").format("memory").queryName("stats").start()
    q.processAllAvailable()
    q.stop()
    assert {r.s: (r.n, round(r["mean"], 6)) for r in spark.table("stats").collect()} == {"a": (3, 1.0), "b": (3, round(5 / 3, 6))}


def test_density_peaks_and_tracks():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(10, 1, 200), rng.normal(20, 1, 150)])
    got = peaktrack.density_peaks(x)
    assert len(got) == 2 and abs(got[0] - 10) < 0.5 and abs(got[1] - 20) < 0.5
    assert peaktrack.density_peaks(np.ones(50)) == [] and peaktrack.density_peaks(np.array([1.0, np.nan])) == []
    found = [[10.0, 20.0]] * 20 + [[10.0]] * 4 + [[10.0, 20.0]] * 10 + [[14.0, 24.0]] * 8
    why = peaktrack.judged(found, np.full(len(found), 100.0))
    assert all("missing_peak" in w for w in why[20:24]) and all("peak_shift" in w for w in why[36:]) and not any(why[:20])


def test_peak_tracking_drops_a_drift(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(50, 2, 6000)
    x[4500:] += 15
    df = spark.createDataFrame([("a", k, float(k), float(v)) for k, v in enumerate(x)], "s string, i long, t double, x double")
    seg = timeqc.segments(df, "s", "i", "t", 1e9)
    binned = timeqc.overlapping_bins(seg, "s", "i", 150)
    ok = peaktrack.retained(binned, peaktrack.flagged_bins(binned, "s", "i", "unwrapped", "x"), "s", "i").toPandas().sort_values("i")
    assert ok.time_ok[:4300].mean() > 0.95 and ok.time_ok[4700:].mean() < 0.2


@pytest.mark.parametrize("name,tolerance", [("bridge", 0.12), ("bridge_extended", 0.12), ("watson_classic", 0.06)])
def test_more_models(name, tolerance):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(100, 5, 6000), rng.uniform(100, 200, 3600) * rng.normal(1, 0.05, 3600), rng.normal(200, 10, 2400)])
    y = np.histogram(x, 256, (0, 300))[0].astype(float)
    r = models.MODELS[name](y, 0.0, 300 / 256, models.peak_pair(y, 0.0, 300 / 256))
    assert max(abs(r["phase_g1"] - 0.5), abs(r["phase_s"] - 0.3), abs(r["phase_g2"] - 0.2)) < tolerance


def test_debris_is_told_from_g1():
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(100, 5, 6000), rng.uniform(100, 200, 1500), rng.normal(200, 10, 1500), rng.exponential(20, 4000)])
    y = np.histogram(x, 256, (0, 300))[0].astype(float)
    r = bridge.bridge_extended(y, 0.0, 300 / 256, {"g1": 100.0, "g2": 200.0, "sd1": 5.0, "sd2": 10.0})
    assert 0.2 < r["share_debris"] < 0.4 and abs(r["phase_g1"] - 6 / 9) < 0.12


def test_series_model():
    p = {"cycle": 90.0, "delay": 10.0, "start": 5.0, "start_sd": 6.0, "speed_sd": 0.05, "gamma1": 0.3, "gamma2": 0.6}
    for t in (0.0, 45.0, 150.0):
        x, d = series.position_density(t, p)
        assert abs(np.trapezoid(d, x) - 1) < 0.02 and abs(series.fractions(t, p).sum() - 1) < 1e-9
    assert series.fractions(0.0, p)[0] > 0.9 and series.fractions(45.0, p)[1] > 0.5
    times = [0.0, 30.0, 45.0, 60.0, 75.0, 100.0]
    centres = (np.arange(64) + 0.5) * 4
    counts = [np.round(4000 * series.bin_shares(t, p, centres, 80.0, 80.0, 8.0)) for t in times]
    got = series.fit_series(times, counts, 0.0, 4.0, (80.0, 80.0, 8.0), starts=1)
    assert max(np.abs(np.array(f) - series.fractions(t, p)).max() for t, f in zip(times, got["fractions"], strict=True)) < 0.1


def test_extended_bridge_returns_its_shares(spark):
    """Shares of aggregates and debris reach the table; models without them have none."""
    rows = {n: catalogue.QUERIES[f"fit_{n}"](spark, SF).collect() for n in ("bridge_extended", "dean_jett_fox")}
    tried = [r for r in rows["bridge_extended"] if not r.reasons]
    assert tried and all(0 <= r.share_aggregate <= 1 and 0 <= r.share_debris <= 1 for r in tried)
    assert all(r.model == "dean_jett_fox" and (r.share_debris is None or math.isnan(r.share_debris)) for r in rows["dean_jett_fox"])
