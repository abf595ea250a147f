"""Local maxima, local bias, pulse channel choice and the singlet gate's review, against values worked out here."""

import numpy as np
import pytest

from eventloom.operators import fitstats, gates
from eventloom.operators.ranking import quantiles
from eventloom.plans import catalogue


def maxima(spark, values):
    df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(values)], "k string, i int, y double")
    return sorted(r.i for r in fitstats.local_maxima(df, "k", "i", "y").collect())


@pytest.mark.parametrize("values,want", [([5, 1, 3, 1, 9], [2]), ([0, 2, 2, 2, 1], [2]), ([0, 2, 2, 1], [1]), ([0, 1, 3, 3], [2]), ([0, 1, 2], []), ([2, 2, 2], []), ([0, 3, 3, 4, 0], [3]), ([0], []), ([], [])])
def test_local_maxima(spark, values, want):
    assert maxima(spark, values) == want


def test_local_bias_is_over_the_robust_scale(spark):
    r = np.random.default_rng(6).normal(0, 3, 40)
    df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(r)] + [("b", k, float(v)) for k, v in enumerate((1, -1, 4))], "k string, i int, r double")
    got = {x.k: (x.bias, x.at) for x in fitstats.local_bias(df, "k", "i", "r").collect()}
    means = [abs(r[k : k + 11].mean()) for k in range(30)]
    assert got["a"] == (pytest.approx(max(means) / (1.4826 * np.median(np.abs(r - np.median(r))))), int(np.argmax(means)))
    assert got["b"] == (pytest.approx((4 / 3) / (1.4826 * 2)), 0)


def test_candidate_peak_pairs_has_rows(spark):
    assert catalogue.QUERIES["candidate_peak_pairs"](spark, "/root/testdata/sf0.01").count() > 0


def test_pulse_channel_choice(spark):
    rng = np.random.default_rng(7)
    a = rng.normal(100, 10, 300)
    rows = [("h", float(x), float(x / 2), float(rng.normal(50, 5))) for x in a] + [("w", float(x), None, float(x)) for x in a] + [("tie", float(x), float(x), float(x)) for x in a] + [("none", None, 1.0, None)]
    df = spark.createDataFrame(rows, "k string, a double, h double, w double")
    got = {r.k: (r.channel, r.score) for r in gates.pulse_channel_choice(df, "k", "a", "h", "w").collect()}
    assert {k: c for k, (c, _) in got.items()} == {"h": "h", "w": "w", "tie": "h", "none": "h"}
    assert got["tie"][1] == pytest.approx(1.300001)
    with pytest.raises(ValueError):
        gates.pulse_channel_choice(df, "k", "a", None, None)


def test_singlet_gate_review(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(100, 10, 600)
    kinds = {"fitted": x / 2 + rng.normal(0, 1, 600), "blob": rng.normal(50, 5, 600), "line": x / 2}
    df = spark.createDataFrame([(k, float(a), float(b)) for k, y in kinds.items() for a, b in zip(x, y, strict=True)], "k string, x double, y double")
    got = {r.k: (r.status, r.review) for r in gates.fit_singlets(df, "k", "x", "y").collect()}
    assert got["fitted"] == ("fitted", []) and got["blob"][0] == "review" and "poorly_identified" in got["blob"][1]
    assert got["line"][0] == "review" and "near_collinear" in got["line"][1]


@pytest.mark.parametrize("nearest", [False, True])
def test_quantiles_of_ties_and_an_outlier(spark, nearest):
    x = np.concatenate([np.repeat([3.0, 7.0, -0.0, 0.0], [500, 400, 2, 3]), np.random.default_rng(9).normal(5, 1, 200), [1e12]])
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    df = spark.createDataFrame([("a", float(v)) for v in x], "k string, x double")
    got = {r.p: r.q for r in quantiles(df, "k", "x", shares, nearest_rank=nearest).collect()}
    s = np.sort(x)
    want = {p: s[int(np.floor((len(s) - 1) * p + 0.5))] if nearest else np.quantile(x, p) for p in shares}
    assert got == {p: pytest.approx(v) for p, v in want.items()}
