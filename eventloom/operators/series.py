"""A joint fit of a synchronised time series (the published CLOCCS cohort model), a task per strain.

A population is a mixture of cohorts of cells by generation; a cohort's position on its lifeline is a truncated Gaussian that
moves and widens with time; position maps to DNA content by phase. Shared parameters and each sample's fluorescence are fitted to
all histograms of a strain at once. As in the published software's own words, results of this model are to be taken as unverified.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import erf

GRID = 400
SHARED = ("cycle", "delay", "start", "start_sd", "speed_sd", "gamma1", "gamma2")


def _cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + erf(z / math.sqrt(2)))


def position_density(t: float, p: dict[str, float], most: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(positions, density) of the lifeline at time t, in minutes; it integrates to 1."""
    pairs = np.array([(0, 0)] + [(g, r) for r in range(1, most + 1) for g in range(1, r + 1)])
    g, r = pairs[:, 0].astype(float), pairs[:, 1].astype(float)
    sd = max(math.hypot(p["start_sd"], t * p["speed_sd"]), 1e-9)
    reach = (p["start"] - t + r * p["cycle"] + (g - 1) * p["delay"]) / sd
    ways = np.array([1.0 if k == 0 else math.comb(int(n) - 1, int(k) - 1) for k, n in pairs])
    mass = np.where(g == 0, 1.0, (1 - _cdf(reach)) * ways)
    mean = t - p["start"] - r * p["cycle"] - g * p["delay"]
    floor = np.where(g == 0, -np.inf, -p["delay"])
    low = min(np.where(np.isfinite(floor), floor, mean - 6 * sd).min(), -1.0, -2 * max(p["delay"], p["start_sd"]))
    x = np.linspace(low, max((mean + 6 * sd).max(), low + 1), GRID)
    tail = 1 - _cdf((floor - mean) / sd)
    z = (x[None] - mean[:, None]) / sd
    each = np.where((x[None] >= floor[:, None]) & (tail[:, None] > 1e-12), np.exp(-0.5 * z * z) / (sd * math.sqrt(2 * math.pi)) / np.maximum(tail, 1e-12)[:, None], 0)
    return x, (mass / mass.sum()) @ each


def phase_of(x: np.ndarray, p: dict[str, float]) -> np.ndarray:
    """0 G1, 1 S, 2 G2/M; before the cycle starts G1."""
    f = np.mod(x, p["cycle"]) / p["cycle"]
    return np.where((x < 0) | (f < p["gamma1"]), 0, np.where(f < p["gamma2"], 1, 2))


def fractions(t: float, p: dict[str, float]) -> np.ndarray:
    x, d = position_density(t, p)
    mid, mass = (x[1:] + x[:-1]) / 2, (d[1:] + d[:-1]) / 2 * np.diff(x)
    out = np.bincount(phase_of(mid, p), mass, 3)
    return out / out.sum()


def bin_shares(t: float, p: dict[str, float], centres: np.ndarray, one: float, step: float, noise: float) -> np.ndarray:
    """The share of each DNA bin: one copy reads `one`, two read one + step, with Gaussian noise."""
    x, d = position_density(t, p)
    f = np.mod(x, p["cycle"]) / p["cycle"]
    dna = one + step * np.where(x < 0, 0, np.clip((f - p["gamma1"]) / (p["gamma2"] - p["gamma1"]), 0, 1))
    w = d * np.gradient(x)
    y = np.exp(-0.5 * ((centres[:, None] - dna[None]) / noise) ** 2) @ w
    return np.maximum(y / max(y.sum(), 1e-300), 1e-15)


def nelder_mead(f, start: np.ndarray, rounds: int = 320, tolerance: float = 1e-5, size: float = 0.15) -> tuple[np.ndarray, float, bool]:
    """A simplex descent: (point, value, converged)."""
    s = np.vstack([start, *[start + np.eye(len(start))[k] * (size if start[k] == 0 else size * max(1, abs(start[k]))) for k in range(len(start))]])
    v = np.array([f(x) for x in s])
    for _ in range(rounds):
        order = np.argsort(v, kind="stable")
        s, v = s[order], v[order]
        if abs(v[-1] - v[0]) <= tolerance * (1 + abs(v[0])):
            return s[0], float(v[0]), True
        centre = s[:-1].mean(axis=0)
        x = centre + (centre - s[-1])
        fx = f(x)
        if fx < v[0]:
            y = centre + 2 * (centre - s[-1])
            fy = f(y)
            s[-1], v[-1] = (y, fy) if fy < fx else (x, fx)
        elif fx < v[-2]:
            s[-1], v[-1] = x, fx
        else:
            y = centre + 0.5 * ((x if fx < v[-1] else s[-1]) - centre)
            fy = f(y)
            if fy < min(fx, v[-1]):
                s[-1], v[-1] = y, fy
            else:
                s[1:] = s[0] + 0.5 * (s[1:] - s[0])
                v[1:] = [f(x) for x in s[1:]]
    return s[v.argmin()], float(v.min()), False


def _decoded(q: np.ndarray) -> dict[str, float]:
    e = np.exp(np.clip(q[:5], -20, 12))
    a = 1 / (1 + math.exp(-q[5]))
    b = a + (1 - a) / (1 + math.exp(-q[6]))
    return dict(zip(SHARED, (*map(float, e), float(np.clip(a, 0.01, 0.97)), float(np.clip(b, 0.02, 0.99))), strict=True))


def fit_series(times: list[float], counts: list[np.ndarray], low: float, width: float, first: tuple[float, float, float], *, starts: int = 3, seed: int = 20260726) -> dict:
    """Shared parameters of a strain by maximum posterior from several seeded starts; `first`: (one copy, step, noise)."""
    centres = [low + (np.arange(len(c)) + 0.5) * width for c in counts]
    guess = float(np.clip(max(times) / 1.5 if max(times) > 0 else 90.0, 40, 200))

    def loss(q: np.ndarray) -> float:
        p = _decoded(q[:7])
        one, step, noise = np.exp(np.clip(q[7:10], -20, 20))
        prior = 0.5 * ((q[0] - math.log(guess)) / 0.35) ** 2 + sum(0.5 * (p[k] / s) ** 2 for k, s in (("delay", 40), ("start", 40), ("start_sd", 30), ("speed_sd", 0.3))) - math.log(p["gamma1"] * (1 - p["gamma1"]) * p["gamma2"] * (1 - p["gamma2"]))
        prior += sum(0.5 * ((v - f) / (0.15 * f)) ** 2 for v, f in zip((one, step), first, strict=False))
        like = -sum(float(c @ np.log(bin_shares(t, p, x, one, step, noise))) for t, c, x in zip(times, counts, centres, strict=True))
        value = like + prior
        return value if math.isfinite(value) else 1e300

    rng, best = np.random.default_rng(seed), None
    base = np.array([math.log(guess), math.log(10), math.log(10), math.log(8), math.log(0.08), -0.8, -0.2, *np.log(first)])
    for k in range(starts):
        x, value, ok = nelder_mead(loss, base + (rng.normal(0, 0.25, len(base)) if k else 0))
        x, value, ok = nelder_mead(loss, x, size=0.05)
        if best is None or value < best[1]:
            best = (x, value, ok)
    p = _decoded(best[0][:7])
    return {**p, "loss": best[1], "converged": best[2], "fractions": [fractions(t, p).tolist() for t in times]}


RESULT = "{by}, times array<double>, cycle double, delay double, start double, start_sd double, speed_sd double, gamma1 double, gamma2 double, loss double, converged boolean, fractions array<array<double>>"


def fitted_series(histograms: DataFrame, by: str, time: str, first: tuple[float, float, float]) -> DataFrame:
    """models.arrays() with a strain and a time -> a row per strain of two samples or more. A strain's input is its histograms."""
    one = histograms.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(time).cast("double").alias("t"), "low", "width", "counts"))).alias("s")).where(F.size("s") >= 2)

    def run(batches):
        for b in batches:
            rows = []
            for key, s in zip(b[by], b["s"], strict=True):
                got = fit_series([x["t"] for x in s], [np.asarray(x["counts"], float) for x in s], s[0]["low"], s[0]["width"], first)
                rows.append({by: key, "times": [x["t"] for x in s], **got})
            yield pd.DataFrame(rows, columns=[by, "times", *SHARED, "loss", "converged", "fractions"])

    return one.repartition(by).mapInPandas(run, RESULT.format(by=f"{by} {dict(histograms.dtypes)[by]}"))
