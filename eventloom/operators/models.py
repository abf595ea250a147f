"""Peaks of DNA histograms and cell-cycle mixture models, fitted per sample on the sample's histogram.

A fit's input is one array of counts per sample, so grouped Python work doesn't grow with events.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ERF

RATIO = (1.65, 2.25)
CV = (0.01, 0.30)
NODES = 32


def arrays(histogram: DataFrame, by: str) -> DataFrame:
    """samples.histogram() -> (by, low, width, counts array)."""
    ordered = F.array_sort(F.collect_list(F.struct("bin", "left", "right", "count")))
    one = histogram.groupBy(by).agg(ordered.alias("b"))
    return one.select(by, F.col("b")[0]["left"].alias("low"), (F.col("b")[0]["right"] - F.col("b")[0]["left"]).alias("width"), F.transform("b", lambda x: x["count"].cast("double")).alias("counts"))


# ---------------------------------------------------------------- numbers


def erf(x: np.ndarray) -> np.ndarray:
    a1, a2, a3, a4, a5, p = ERF
    t = 1 / (1 + p * np.abs(x))
    return np.sign(x) * (1 - ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t * np.exp(-x * x))


def bin_mass(edges: np.ndarray, mean, sd) -> np.ndarray:
    """Mass of Gaussians between edges; mean and sd may be columns."""
    return np.diff(0.5 * (1 + erf((edges - mean) / (sd * math.sqrt(2)))), axis=-1)


def smooth(y: np.ndarray, sd: float) -> np.ndarray:
    reach = math.ceil(4 * sd)
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sd) ** 2)
    return np.convolve(y, k, "same")[: len(y)] / np.convolve(np.ones(len(y)), k, "same")[: len(y)] if len(y) > 2 * reach else y.astype(float)


def least_squares(residuals: Callable[[np.ndarray], np.ndarray], start: np.ndarray, project: Callable[[np.ndarray], np.ndarray], *, rounds: int = 200, tolerance: float = 1e-8, difference: float = 1e-4) -> tuple[np.ndarray, float, bool]:
    """Damped, projected Levenberg-Marquardt with central differences: (parameters, objective, converged)."""
    x = project(np.asarray(start, float))
    r = residuals(x)
    value, damp = float(r @ r), 1e-2
    for _ in range(rounds):
        jac = np.empty((len(r), len(x)))
        for k in range(len(x)):
            h = difference * max(abs(x[k]), 1e-3)
            up, down = x.copy(), x.copy()
            up[k] += h
            down[k] -= h
            jac[:, k] = (residuals(up) - residuals(down)) / (2 * h)
        g, a = jac.T @ r, jac.T @ jac
        while damp <= 1e12:
            try:
                move = np.linalg.solve(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), -g)
            except np.linalg.LinAlgError:
                damp *= 10
                continue
            new = project(x + move)
            rn = residuals(new)
            vn = float(rn @ rn)
            if np.isfinite(vn) and vn <= value:
                gain, step = value - vn, np.abs(new - x).max() / max(1.0, np.abs(x).max())
                x, r, value, damp = new, rn, vn, max(damp / 3, 1e-12)
                if gain <= tolerance * max(value, 1.0) and step <= 1e-6:
                    return x, value, True
                break
            damp *= 10
        else:
            return x, value, bool(np.abs(g).max() < 1e-3 * max(1.0, value))
    return x, value, False


def deviance_residuals(y: np.ndarray, mu: np.ndarray) -> np.ndarray:
    m = np.maximum(mu, 1e-12)
    d = 2 * (np.where(y > 0, y * np.log(np.maximum(y, 1e-300) / m), 0.0) - (y - m))
    return np.sign(y - m) * np.sqrt(np.maximum(d, 0))


# ---------------------------------------------------------------- peaks


@dataclass
class Peak:
    bin: int
    height: float
    prominence: float
    sd: float


def peaks(y: np.ndarray, sd: float = 2.0, least: float = 0.02) -> list[Peak]:
    """Maxima of the smoothed counts by topographic prominence, of at least `least` of the highest; width by the prominence."""
    s = smooth(y, sd)
    top, out = s.max() if len(s) else 0, []
    i = 0
    while i < len(s):
        j = i
        while j + 1 < len(s) and s[j + 1] == s[i]:
            j += 1
        if (i == 0 or s[i - 1] < s[i]) and (j == len(s) - 1 or s[j + 1] < s[i]) and s[i] > 0:
            k = (i + j) // 2
            left = right = s[k]
            a = k
            while a > 0 and s[a - 1] <= s[k]:
                a -= 1
                left = min(left, s[a])
            b = k
            while b < len(s) - 1 and s[b + 1] <= s[k]:
                b += 1
                right = min(right, s[b])
            prominence = s[k] - max(left if a > 0 else 0.0, right if b < len(s) - 1 else 0.0)
            if prominence >= least * top:
                level = s[k] - prominence / 2
                lo = k
                while lo > 0 and s[lo] > level:
                    lo -= 1
                hi = k
                while hi < len(s) - 1 and s[hi] > level:
                    hi += 1
                out.append(Peak(k, float(s[k]), float(prominence), max((hi - lo) / 2.355, 0.5)))
        i = j + 1
    return out


def peak_pair(y: np.ndarray, low: float, width: float, *, ratio: tuple[float, float] = (1.6, 2.35)) -> dict | None:
    """The pair of peaks that looks most like G1 and G2, over several smoothing scales; G2 is inferred at twice G1 if there is no
    second peak. Keys: g1, g2 (values), sd1, sd2, confidence, status."""
    if y.sum() < 100 or (y > 0).sum() < 5:
        return None
    at = lambda k: low + (k + 0.5) * width
    seen: dict[tuple[int, int], float] = {}
    found = [peaks(y, s) for s in (1.0, 2.0, 4.0)]
    main = found[1] or found[0] or found[2]
    if not main:
        return None
    for a in main:
        for b in main:
            r = at(b.bin) / at(a.bin) if at(a.bin) > 0 else 0
            if b.bin > a.bin and ratio[0] <= r <= ratio[1]:
                keeps = np.mean([min(abs(p.bin - a.bin) for p in f) <= 4 and min(abs(p.bin - b.bin) for p in f) <= 4 if f else False for f in found])
                top = max(p.prominence for p in main)
                near = math.exp(-0.5 * ((r - 2) / 0.12) ** 2)
                seen[main.index(a), main.index(b)] = near**0.4 * (a.prominence / top) ** 0.25 * (b.prominence / top) ** 0.1 * (0.25 + 0.75 * keeps) ** 0.25
    if seen:
        values = np.array(sorted(seen.values(), reverse=True))
        (i, j), best = max(seen.items(), key=lambda kv: (kv[1], -kv[0][0], -kv[0][1]))
        share = float(1 / np.exp((values - best) / 0.08).sum())
        a, b = main[i], main[j]
        return {"g1": at(a.bin), "g2": at(b.bin), "sd1": a.sd * width, "sd2": b.sd * width, "confidence": share * best, "status": "detected" if best >= 0.52 else "low_confidence"}
    a = max(main, key=lambda p: 0.85 * p.prominence / max(q.prominence for q in main) + 0.15 * (1 - p.bin / len(y)))
    return {"g1": at(a.bin), "g2": 2 * at(a.bin), "sd1": a.sd * width, "sd2": 2 * a.sd * width, "confidence": 0.3, "status": "inferred_g2"}


# ---------------------------------------------------------------- models


def _s_phase(edges: np.ndarray, m1: float, m2: float, cv: float, profile: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Counts of an S phase with DNA density profile(z) over z in 0..1 between the means, broadened by cv; its area is 1."""
    z, w = np.polynomial.legendre.leggauss(NODES)
    z, w = (z + 1) / 2, w / 2
    q = np.maximum(profile(z), 0) * w
    total = q.sum()
    if not total > 0:
        return np.zeros(len(edges) - 1)
    x = m1 + z * (m2 - m1)
    return (q / total) @ bin_mass(edges[None, :], x[:, None], (cv * x)[:, None])


def _dean_jett(p: np.ndarray, edges: np.ndarray, wave: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a1, m1, c1, a2, r, c2, s, b, c = p[:9]
    m2 = r * m1
    base = lambda z: 1 + b * (2 * z - 1) + c * (6 * z * (z - 1) + 1)
    if wave:
        w, at, sd = p[9:]
        g = lambda z: np.exp(-0.5 * ((z - at) / sd) ** 2)
        norm = sd * math.sqrt(2 * math.pi)
        profile = lambda z: (1 - w) * np.maximum(base(z), 0) + w * g(z) / norm
    else:
        profile = base
    return a1 * bin_mass(edges, m1, c1 * m1), s * _s_phase(edges, m1, m2, (c1 + c2) / 2, profile), a2 * bin_mass(edges, m2, c2 * m2)


def _project(p: np.ndarray, wave: bool) -> np.ndarray:
    p = p.copy()
    p[[0, 3, 6]] = np.maximum(p[[0, 3, 6]], 0)
    p[1] = max(p[1], 1e-9)
    p[[2, 5]] = np.clip(p[[2, 5]], *CV)
    p[4] = np.clip(p[4], *RATIO)
    p[7], p[8] = np.clip(p[7], -1, 1), np.clip(p[8], -0.5, 1)
    if wave:
        p[9], p[10], p[11] = np.clip(p[9], 0, 0.95), np.clip(p[10], 0.02, 0.98), np.clip(p[11], 0.02, 0.5)
    return p


def _result(model: str, y: np.ndarray, parts: tuple[np.ndarray, ...], k: int, converged: bool, extra: dict) -> dict:
    areas = [float(x.sum()) for x in parts]
    total, mu = sum(areas), sum(parts)
    d = deviance_residuals(y, mu)
    deviance, c = float(d @ d), d - d.mean()
    lag1 = float((c[1:] * c[:-1]).sum() / max((c * c).sum(), 1e-300))
    g1, s, g2 = (a / total if total > 0 else math.nan for a in areas)
    return {"model": model, "phase_g1": g1, "phase_s": s, "phase_g2": g2, "converged": converged, "deviance": deviance, "bic": deviance + k * math.log(len(y)), "lag1": lag1, **extra}


def dean_jett(y: np.ndarray, low: float, width: float, pair: dict, *, wave: bool = False) -> dict:
    """Gaussian G1 and G2 and a quadratic S phase; with `wave` also a Gaussian wave of synchronised cells in S (Dean-Jett-Fox).
    The best of several starts by Poisson deviance."""
    edges = low + np.arange(len(y) + 1) * width
    n, m1, r = y.sum(), pair["g1"], float(np.clip(pair["g2"] / pair["g1"], *RATIO))
    cv = float(np.clip(pair["sd1"] / pair["g1"], CV[0] * 1.5, CV[1] / 2))
    centres = edges[:-1] + width / 2
    between = float(y[(centres > m1 * (1 + 2 * cv)) & (centres < m1 * r * (1 - 2 * cv))].sum())
    left = float(y[centres < m1].sum()) * 2
    right = float(y[centres > m1 * r].sum()) * 2
    base = [min(left, 0.95 * n), m1, cv, min(max(right, 0.02 * n), 0.95 * n), r, cv, max(between, 0.05 * n), 0.0, 0.0]
    starts = [base, [*base[:6], 0.3 * n, 0.4, 0.1], [*base[:6], 0.3 * n, -0.4, 0.1], [*base[:2], cv * 0.7, *base[3:5], cv * 0.7, *base[6:]]]
    if wave:
        starts = [[*s, w, at, 0.12] for s in starts[:1] for w, at in ((0.3, 0.25), (0.3, 0.5), (0.3, 0.75), (0.05, 0.5))]
    best = None
    unit = np.abs(np.array(starts[0])) + np.where(np.array(starts[0]) == 0, 1.0, 0.0)  # parameters of like size
    fit = lambda s, rounds: least_squares(lambda q: deviance_residuals(y, sum(_dean_jett(_project(q * unit, wave), edges, wave))), s, lambda q: _project(q * unit, wave) / unit, rounds=rounds)
    for s in starts:  # a few rounds from each start, then the best one to its end
        x, value, ok = fit(np.array(s) / unit, 12)
        if best is None or value < best[1]:
            best = (x, value, ok)
    if not best[2]:
        best = fit(best[0], 100)
    best = (best[0] * unit, *best[1:])
    p = best[0]
    wave_share = float(p[9]) if wave else 0.0
    on_bound = wave and not (0.02 < p[9] < 0.94 and 0.03 < p[10] < 0.97 and 0.021 < p[11] < 0.49)
    return _result("dean_jett_fox" if wave else "dean_jett", y, _dean_jett(p, edges, wave), len(p), best[2], {"mean1": float(p[1]), "ratio": float(p[4]), "cv": float(p[2]), "cv_upper": CV[1], "wave": wave_share, "on_bound": bool(on_bound)})


def watson(y: np.ndarray, low: float, width: float, pair: dict) -> dict:
    """Peaks from their outer flanks at 60 % of the height, in closed form; S is what is left between the means. It doesn't
    iterate, so it never claims to have converged."""
    edges = low + np.arange(len(y) + 1) * width
    centres, s = edges[:-1] + width / 2, smooth(y, 2.0)

    def flank(mean: float, side: int) -> tuple[float, float]:
        k = int(np.clip((mean - low) / width, 0, len(y) - 1))
        j = k
        while 0 < j < len(y) - 1 and s[j] > 0.6 * s[k]:
            j += side
        sd = max(abs(centres[j] - centres[k]) / math.sqrt(-2 * math.log(0.6)), width / 2)
        near = (centres >= mean - (3 if side < 0 else 1) * sd) & (centres <= mean + (1 if side < 0 else 3) * sd)
        shape = bin_mass(edges, mean, sd)
        return sd, float(y[near].sum() / max(shape[near].sum(), 1e-12))

    (sd1, a1), (sd2, a2) = flank(pair["g1"], -1), flank(pair["g2"], 1)
    one, two = a1 * bin_mass(edges, pair["g1"], sd1), a2 * bin_mass(edges, pair["g2"], sd2)
    between = np.where((centres > pair["g1"]) & (centres < pair["g2"]), np.maximum(y - one - two, 0), 0)
    return _result("watson_pragmatic", y, (one, between, two), 6, False, {"mean1": pair["g1"], "ratio": pair["g2"] / pair["g1"], "cv": sd1 / pair["g1"], "cv_upper": CV[1], "wave": 0.0, "on_bound": False})


def auto(y: np.ndarray, low: float, width: float, pair: dict) -> dict:
    """Dean-Jett, unless Dean-Jett-Fox is better by 6 in BIC, has less structure in its residuals, and its wave is no bound."""
    plain, fox = dean_jett(y, low, width, pair), dean_jett(y, low, width, pair, wave=True)
    better = fox["converged"] and not fox["on_bound"] and fox["wave"] >= 0.01 and plain["bic"] - fox["bic"] >= 6 and abs(plain["lag1"]) - abs(fox["lag1"]) >= 0.05
    return fox if better or not plain["converged"] and fox["converged"] and not fox["on_bound"] else plain


Model = Callable[[np.ndarray, float, float, dict], dict]
MODELS: dict[str, Model] = {}


def register_model(name: str, fit: Model) -> None:
    """Adds a model: fit(counts, low, width, peak pair) -> a result with the keys of the ones here."""
    if not callable(fit) or not name:
        raise ValueError("a model needs a name and a function")
    MODELS[name] = fit


for _name, _fit in (("dean_jett", dean_jett), ("dean_jett_fox", lambda *a: dean_jett(*a, wave=True)), ("watson_pragmatic", watson), ("auto", auto)):
    register_model(_name, _fit)

PAIR = "{by}, g1 double, g2 double, sd1 double, sd2 double, confidence double, status string"
FIT = "{by}, model string, phase_g1 double, phase_s double, phase_g2 double, converged boolean, deviance double, bic double, lag1 double, mean1 double, ratio double, cv double, cv_upper double, wave double, share_aggregate double, share_debris double, reasons array<string>"


def detected_peaks(histograms: DataFrame, by: str) -> DataFrame:
    """arrays() -> the peak pair of each sample; status none where nothing looks like one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{by: k, **(peak_pair(np.asarray(c, float), lo, w) or {"status": "none"})} for k, lo, w, c in zip(b[by], b["low"], b["width"], b["counts"], strict=True)]
            yield pd.DataFrame(rows, columns=[by, "g1", "g2", "sd1", "sd2", "confidence", "status"])

    return histograms.select(by, "low", "width", "counts").mapInPandas(run, PAIR.format(by=f"{by} {dict(histograms.dtypes)[by]}"))


def fitted(histograms: DataFrame, pairs: DataFrame, by: str, model: str = "auto", *, least_events: int = 100, least_bins: int = 5) -> DataFrame:
    """arrays() and reviewed pairs(by, g1, g2, sd1, sd2) -> a fit per sample. reasons: why a fit was not tried."""
    fit = MODELS[model]
    joined = histograms.join(pairs.select(by, "g1", "g2", "sd1", "sd2"), by, "left").repartition(by)
    names = [x.split()[0] for x in FIT.format(by=by).split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                y = np.asarray(r.counts, float)
                why = [n for n, bad in (("few_events", y.sum() < least_events), ("few_bins", (y > 0).sum() < least_bins), ("no_regions", r.g1 is None or not np.isfinite(r.g1))) if bad]
                got = {} if why else fit(y, r.low, r.width, {"g1": r.g1, "g2": r.g2, "sd1": r.sd1, "sd2": r.sd2})
                rows.append({"model": model, **got, by: getattr(r, by), "reasons": why})
            yield pd.DataFrame(rows, columns=names)

    return joined.mapInPandas(run, FIT.format(by=f"{by} {dict(histograms.dtypes)[by]}"))
