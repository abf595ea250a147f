"""The prefix scan of time segments and the bracketed selection of quantiles, against plain loops and sorts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import samples, timeqc
from eventloom.operators.ranking import indexed, quantiles

RANGE = 100.0


def sequential(times):
    """[(segment, unwrapped)], an event at a time."""
    out, segment, before, upto, offset = [], -1, None, None, 0.0
    for t in times:
        if t is None or not math.isfinite(t) or t < 0:
            before = None
            out.append((None, None))
            continue
        if before is None:
            segment, offset, upto = segment + 1, 0.0, None
        elif t < before - 1e-6:
            if before > 0.8 * RANGE and t < 0.2 * RANGE:
                offset += RANGE
            else:
                segment, offset, upto = segment + 1, 0.0, None
        now = t + offset if upto is None else max(upto, t + offset)
        out.append((segment, now))
        before = upto = now
        before = t
    return out


def bins_of(n, target):
    k = max(1, math.floor(n / target + 0.5))
    return [b for b in range(k) for _ in range(b * n // k, (b + 1) * n // k)]


def runs(seed, n=200):
    rnd, t, out = random.Random(seed), 0.0, []
    for _ in range(n):
        x = rnd.random()
        t = t + rnd.random() * 8 if x < 0.9 else rnd.random() * RANGE
        t = t - RANGE if t > RANGE else t
        out.append(None if x > 0.97 else float("nan") if x > 0.96 else -1.0 if x > 0.95 else t - 5e-7 if x > 0.85 and t > 1 else t)
    return out


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_segments_of_any_block_size(spark, block):
    data = {f"s{k}": runs(k) for k in range(4)} | {"wraps": [90.0, 5.0] * 10, "flat": [5.0] * 9, "none": [None, None], "long": [1.0] * 5 + [99.0] + [1.0] * 20 + [99.0, 1.0]}
    df = spark.createDataFrame([(s, 3 * i, t) for s, x in data.items() for i, t in enumerate(x)], "s string, i long, t double")
    found = timeqc.segments(df, "s", "i", "t", RANGE, block=block, blocks=True)
    got = {(r.s, r.i): (r.segment, r.unwrapped) for r in found.collect()}
    for s, x in data.items():
        want = sequential(x)
        for i, (seg, u) in enumerate(want):
            assert got[s, 3 * i][0] == seg and (u is None and got[s, 3 * i][1] is None or math.isclose(got[s, 3 * i][1], u)), (s, i)
    binned = {(r.s, r.i): r.bin for r in timeqc.equal_count_bins(found, "s", "i", 5).collect()}
    for s, x in data.items():
        members = {}
        for i, (seg, _) in enumerate(sequential(x)):
            if seg is not None:
                members.setdefault(seg, []).append(i)
        for rows in members.values():
            assert [binned[s, 3 * i] for i in rows] == bins_of(len(rows), 5)


def test_bins_of_masked_events(spark):
    df = spark.createDataFrame([("a", i, float(i), i % 3 > 0) for i in range(30)], "s string, i long, t double, m boolean")
    seg = timeqc.segments(df, "s", "i", "t", RANGE, block=4)
    got = {r.i: r.bin for r in timeqc.equal_count_bins(seg, "s", "i", 5, mask=F.col("m")).collect()}
    assert got == dict(zip([i for i in range(30) if i % 3], bins_of(20, 5), strict=True))
    assert timeqc.overlapping_bins(seg, "s", "i", 10, mask=F.col("m")).where("bin = 0").count() == 10


def test_no_window_holds_a_sample_of_events(spark):
    df = spark.createDataFrame([("a", 0, 0.0)], "s string, i long, t double")
    plan = timeqc.equal_count_bins(timeqc.segments(df, "s", "i", "t", RANGE, blocks=True), "s", "i")._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line and ("lag(_t" in line or "row_number" in line or "_wrap" in line):
            assert "_block" in line.partition("], [")[2] or "_cut" in line.partition("], [")[2], line


def test_indexed_with_several_keys_and_totals(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("a"), (F.col("id") % 3).alias("b"), (F.col("id") * 5).alias("o"))
    for r in indexed(df, ["a", "b"], "o", "k", block=20, total="n").groupBy("a", "b").agg(F.sort_array(F.collect_list("k")).alias("k"), F.max("n").alias("n")).collect():
        assert r.k == list(range(r.n))


@pytest.mark.parametrize("accuracy", [40, 10_000])
def test_quantiles_of_odd_spreads(spark, accuracy):
    rng = np.random.default_rng(0)
    groups = {
        "outlier": np.append(rng.normal(50, 3, 400), [1e300, -1e300]), "ties": np.repeat([2.0, 7.0], [300, 101]), "tiny": rng.normal(0, 1e-310, 50),
        "signs": rng.normal(0, 1, 301), "near": 1.7e9 + rng.random(200) * 1e-3, "zero": np.zeros(5), "powers": 2.0 ** np.arange(-500, 500, 7),
    }
    df = spark.createDataFrame([(g, float(v), float(-v)) for g, x in groups.items() for v in x] + [("outlier", float("nan"), None), ("outlier", float("inf"), float("-inf"))], "g string, x double, y double")
    shares = [0.0, 0.013, 0.5, 0.77, 1.0]
    got = {(r.g, r.column, r.p): r.q for r in quantiles(df, "g", ["x", "y"], shares, accuracy=accuracy).collect()}
    near = {(r.g, r.p): r.q for r in quantiles(df, "g", "x", shares, nearest_rank=True, accuracy=accuracy).collect()}
    for g, x in groups.items():
        for p in shares:
            for c, v in (("x", np.sort(x)), ("y", np.sort(-x))):
                k = (len(v) - 1) * p
                want = v[int(k)] if k == int(k) else v[int(k)] * (math.ceil(k) - k) + v[math.ceil(k)] * (k - math.floor(k))
                assert got[g, c, p] == pytest.approx(want, rel=1e-12), (g, c, p)
            assert near[g, p] == np.sort(x)[math.floor((len(x) - 1) * p + 0.5)]


def test_statistics_of_several_channels(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, -1.0), ("b", None, float("nan"))], "s string, x double, y double")
    got = {(r.s, r.channel): (r.n, r["mean"], r["median"], r["min"], r["max"]) for r in samples.channel_stats(df, "s", ["x", "y"]).collect()}
    assert got == {("a", "x"): (2, 2.0, 2.0, 1.0, 3.0), ("a", "y"): (1, 5.0, 5.0, 5.0, 5.0), ("b", "x"): (0, None, None, None, None), ("b", "y"): (0, None, None, None, None)}


def test_far_and_equal_values(spark):
    """Of 200,000 values one is 1e300 and half are equal."""
    n = 200_000
    x = F.when(F.col("id") == 0, 1e300).when(F.col("id") % 2 == 0, 7.0).otherwise((F.col("id") * 7919 % n) / 1000.0)
    df = spark.range(n).select(F.lit("a").alias("g"), x.alias("x"))
    ordered = np.sort(np.array([r.x for r in df.select("x").collect()]))
    found = quantiles(df, "g", "x", [0.1, 0.9])
    got = {r.p: r.q for r in found.collect()}
    assert got == {p: pytest.approx(np.quantile(ordered, p), rel=1e-12) for p in (0.1, 0.9)}
