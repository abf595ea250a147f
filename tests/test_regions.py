"""Peak widths, proposed regions and local estimates against plain loops."""

import math

import numpy as np
import pytest

from eventloom.operators import regions


def bins_of(spark, curves):
    rows = [(s, k, 10.0 * k, 10.0 * (k + 1), float(v)) for s, y in curves.items() for k, v in enumerate(y)]
    return spark.createDataFrame(rows, "s string, bin long, left double, right double, y double")


def smooth(y, sigma=2.0):
    r = max(1, math.ceil(4 * sigma))
    out = []
    for i in range(len(y)):
        near = [(math.exp(-0.5 * ((j - i) / sigma) ** 2), y[j]) for j in range(max(0, i - r), min(len(y), i + r + 1))]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def crossing(y, peak, level, step):
    k = peak
    while 0 < k < len(y) - 1 and y[k] > level or k in (0, len(y) - 1) and 0 <= k + step < len(y) and y[k] > level:
        k += step
    if y[k] > level or k == peak:
        return float(k)
    inner = y[k - step]
    return k - step * min(1.0, max(0.0, (level - y[k]) / (inner - y[k])))


def curves():
    x = np.arange(64)
    two = 200 * np.exp(-0.5 * ((x - 20) / 3) ** 2) + 90 * np.exp(-0.5 * ((x - 41) / 4) ** 2) + 10
    return {"two": two, "edge": np.linspace(50, 1, 64), "flat": np.full(64, 5.0), "late": np.linspace(1, 50, 64)}


def test_smoothing(spark):
    y = np.random.default_rng(0).poisson(20, 40).astype(float)
    got = [r.smooth for r in regions.smoothed(bins_of(spark, {"a": y}), "s").orderBy("bin").collect()]
    assert np.allclose(got, smooth(y))
    assert [r.smooth for r in regions.smoothed(bins_of(spark, {"a": y}), "s", sigma=0.0).orderBy("bin").collect()] == list(y)


def test_widths(spark):
    data, unit = curves(), math.sqrt(2 * math.log(2))
    peaks = [("two", 20), ("two", 41), ("edge", 0), ("flat", 30), ("late", 63)]
    got = {(r.s, r.peak): r for r in regions.measured(bins_of(spark, data), spark.createDataFrame(peaks, "s string, peak long"), "s", "y").collect()}
    for s, p in peaks:
        y, r = list(data[s]), got[s, p]
        left, right = y[max(0, p - 24) : p] or [y[p]], y[p + 1 : p + 25] or [y[p]]
        base = max(min(left), min(right))
        prominence = max(0.0, y[p] - base)
        a, b = crossing(y, p, y[p] - 0.5 * prominence, -1), crossing(y, p, y[p] - 0.5 * prominence, 1)
        assert (r.prominence, r.baseline, r.left_crossing, r.right_crossing) == pytest.approx((prominence, base, a, b)), (s, p)
        assert (r.width_bins, r.sigma_left, r.sigma_right) == pytest.approx((max(0.5, b - a), max(0.5, (p - a) / unit), max(0.5, (b - p) / unit)))
    with pytest.raises(ValueError):
        regions.measured(bins_of(spark, data), spark.createDataFrame(peaks, "s string, peak long"), "s", "y", height=1.0)


def test_proposals(spark):
    pairs = spark.createDataFrame([("two", 20, 41, True, True), ("edge", 10, 20, True, False), ("flat", 30, 32, False, False)], "s string, g1 long, g2 long, g1_found boolean, g2_found boolean")
    bins = bins_of(spark, curves())
    got = {r.s: r for r in regions.proposed(bins, pairs, "s", "y").collect()}
    two = got["two"]
    assert two.g1_left < 205 - 2.5 * 30 < 205 < two.g1_right <= two.g2_left < 415 < two.g2_right and (two.g1_source, two.g2_source) == ("detected", "detected")
    assert 205 - two.g1_left > 1.7 * (two.g1_right - 205)  # farther on the flank away from the other peak
    flat = got["flat"]
    assert (flat.g1_right, flat.g2_left) == (315.0, 315.0) and flat.g1_fallback and flat.g2_source == "inferred"  # they end in the middle
    assert got["edge"].g2_source == "inferred" and not got["edge"].g1_fallback and got["edge"].g2_fallback


def test_estimates(spark):
    bins = bins_of(spark, curves())
    asked = [("two", "G1", 120.0, 290.0, "left"), ("two", "narrow", 190.0, 225.0, "left"), ("flat", "none", 100.0, 200.0, "right"), ("flat", "outside", 900.0, 950.0, "left")]
    got = {(r.s, r.label): r for r in regions.estimated(bins, spark.createDataFrame(asked, "s string, label string, left double, right double, clean string"), "s", "y").collect()}
    g1 = got["two", "G1"]
    assert (g1.peak, g1["mean"], g1.method) == (20, 205.0, "flank") and g1.sigma == pytest.approx(4 / math.sqrt(2 * math.log(2)) * 10)
    assert got["two", "narrow"].method == "moment" and 0 < got["two", "narrow"].sigma < 20
    assert got["flat", "none"].method == "span" and got["flat", "none"].sigma == 25.0 and got["flat", "none"].area == 1.0
    assert got["flat", "outside"].method == "none" and got["flat", "outside"].sigma is None
